"""Ids, spans and decoded texts against the library itself, also for a model with a real character map."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from glucoframe.llm import piece_encoding

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "", " ", "   ", "a", " a ", "Hello  world", "line\nnext\tcell\r\n", "▁▁already ▁ marked▁", "naïve café Ünï 😀😀 漢字 ​ zero\0byte", "x" * 500,
    "ＡＢＣ　ﬁ  ㍿ ¨ ½ é   ﷺ", " lead and trail 　", "<s> </s> <unk> <0x41>", "12345 6.7e-8", " \n " * 50, "a b" * 1000, "각각 각", "ｶﾞｷﾞ ﾊﾟ",
    "\U0001f9ff\U00013000x\U00013001", "\U00013000", "a\u0378\U00013000 \u0378\n\n\u0378", "\n", "\n\n a\tb\r",
]


def random_texts(count):
    rng = random.Random(3)
    return ["".join(rng.choice(["the ", "▁", " ", "é", "ﬁ", "ｶﾞ", "　", "😀", "word", "\n", "½", "각", "é", "¨", "7", "\U0001f468‍", "\U00013000", "\u0378"]) for _ in range(rng.randrange(60))) for _ in range(count)]


def mapped_model(squeeze: bool, dummy: bool) -> bytes:
    """The vocabulary with the library's own NFKC character map instead of none."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    proto.normalizer_spec.CopyFrom(sentencepiece_model_pb2.ModelProto.FromString(rules).normalizer_spec)
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, dummy
    return proto.SerializeToString()


def spans_of_library(processor, text):
    return [(p.id, p.begin, p.end) for p in processor.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("model", [open(MODEL, "rb").read(), mapped_model(True, True), mapped_model(False, True), mapped_model(True, False)], ids=["identity", "squeezed", "kept", "bare"])
def test_ids_and_spans_equal_the_library(model):
    processor, ours = sentencepiece.SentencePieceProcessor(model_proto=model), piece_encoding.Encoder(model)
    for text in TEXTS + random_texts(400):
        ids, starts, ends = ours.encode(text)
        assert ids.tolist() == [1, *processor.encode(text), 2]
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist()))[1:-1] == spans_of_library(processor, text)
        assert ours.decode(ids.tolist()) == processor.decode(processor.encode(text))


def test_spans_cut_the_text_at_its_words():
    text = "Ein  Haus 😀 steht"
    _, starts, ends = piece_encoding.encoder(MODEL).encode(text)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw


def test_character_map_holds_every_rule():
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = sentencepiece_model_pb2.ModelProto.FromString(rules).normalizer_spec
    found = piece_encoding.character_map(spec.precompiled_charsmap)
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    assert len(found) > 10_000 and found["ﬁ"] == "fi" and found["ｶﾞ"] == "ガ"
    assert all(library.normalize(source) == target for source, target in found.items())
    assert piece_encoding.character_map(b"") == {}


@pytest.mark.parametrize("stretch", [1, 7])
def test_short_stretches_change_nothing(monkeypatch, stretch):
    monkeypatch.setattr(piece_encoding, "STRETCH", stretch)
    ours, processor = piece_encoding.Encoder(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in TEXTS + ["one two three four five one two", "five four " + "y" * 100]:
        assert ours.encode(text)[0].tolist() == [1, *processor.encode(text), 2]


def test_other_models_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    proto.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        piece_encoding.Encoder(proto.SerializeToString())


def test_one_long_text_takes_little_time():
    started = time.time()
    ids, _, ends = piece_encoding.encoder(MODEL).encode("Some words, repeated.\n" * 100_000)
    assert len(ids) > 500_000 and ends[-1] == 2_200_000 and time.time() - started < 20


def test_documents_and_odd_rows(spark, docs_folder, odd_docs, no_docs):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (spark.read.parquet(f"{docs_folder}/documents.parquet"), odd_docs):
        made = piece_encoding.encode(docs, MODEL)
        found = sorted(
            (r.doc_id or -1, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.text)
            for r in made.select("doc_id", "n_tokens", "ids", piece_encoding.decoded(made["ids"], MODEL).alias("text")).collect()
        )
        wanted = []
        for row in docs.select("doc_id", "text").collect():
            ids = [1, *processor.encode(row.text or ""), 2]
            wanted.append((row.doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), processor.decode(ids)))
        assert found == sorted(wanted)
        assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in made.collect())
    assert piece_encoding.encode(no_docs, MODEL).count() == 0
