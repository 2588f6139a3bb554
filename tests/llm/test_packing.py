from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from glucoframe.llm import packing
from glucoframe.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    made = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    made.encode_special_tokens = True
    return made


def check(pieces, texts, tokenizer, length=packing.LENGTH):
    """Every id of every row once, sequences filled without gaps."""
    places: dict = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.n))
    for k, sequence in places.items():
        at = 0
        for offset, n in sorted(sequence):
            assert offset == at
            at += n
        assert at == length or k == max(places)
    got = sorted((r.doc_id or -1, r.start, bytes(r.ids)) for r in pieces)
    assert sorted(places) == list(range(len(places)))
    total = {}
    for doc, ids in texts:
        total.setdefault(doc or -1, []).append(np.array(ids + [0], "<u4").tobytes())
    for doc, wanted in total.items():
        have = [(s, ids) for d, s, ids in got if d == doc]
        assert sum(len(ids) for _, ids in have) == sum(map(len, wanted))
        if len(wanted) == 1:
            assert b"".join(ids for _, ids in sorted(have)) == wanted[0]
    return places


def test_documents_round_trip(spark, docs_folder, tokenizer):
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    pieces = packing.pack(docs.repartition(3), *vocabulary()).collect()
    texts = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    check(pieces, texts, tokenizer)
    assert all(r.doc_tokens == len(ids) + 1 for r in pieces for d, ids in texts if d == r.doc_id)


def test_windows_hold_the_target_proportions(spark):
    rows = [(k, "abcd"[k % 4] if k % 7 else "a", "word " * (k % 90 + 5)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    pieces = packing.pack(docs, *vocabulary(), length=256, window_sequences=8).collect()
    source = {k: s for k, s, _ in rows}
    total, window = {}, {}
    for r in pieces:
        total[source[r.doc_id]] = total.get(source[r.doc_id], 0) + r.n
        key = (r.sequence_id // 8, source[r.doc_id])
        window[key] = window.get(key, 0) + r.n
    tokens, windows = sum(total.values()), max(k for k, _ in window)
    for k in range(windows):
        for s in total:
            assert abs(window.get((k, s), 0) - 2048 * total[s] / tokens) <= 4


def test_given_proportions_hold_until_a_queue_is_dry(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], "word " * 99) for k in range(400)], "doc_id long, source string, text string")
    pieces = packing.pack(docs, *vocabulary(), length=128, window_sequences=4, proportions={"a": 3, "b": 1}).collect()
    first = [r for r in pieces if r.sequence_id < 4]
    share = sum(r.n for r in first if r.doc_id % 2 == 0) / sum(r.n for r in first)
    assert abs(share - 0.75) < 0.01


def test_deficits_are_carried():
    left, deficits, served = np.array([10_000, 100, 7]), np.zeros(3), np.zeros(3, int)
    for k in range(1, 101):
        given, deficits = packing.deal(left, np.array([10_000.0, 100, 7]), deficits, 101)
        served += given
        left = left - given
        assert given.sum() == min(101, given.sum() + left.sum())
        assert (abs(served - k * 101 * np.array([10_000, 100, 7]) / 10_107) <= 2).all() or k == 100


def test_odd_rows(odd_docs, no_docs, tokenizer):
    pieces = packing.pack(odd_docs, *vocabulary()).collect()
    texts = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in odd_docs.select("doc_id", "text").collect()]
    check(pieces, texts, tokenizer)
    assert packing.pack(no_docs, *vocabulary()).count() == 0


def test_both_libraries_agree_on_every_character(tokenizer):
    encoder = packing._encoder(*vocabulary())
    letters = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)} !{chr(c)}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 20_000):
        some = letters[at : at + 20_000]
        assert [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)] == [encoder.encode_ordinary(t) for t in some]
    text = "<|endoftext|>  two  spaces\n\n 's <|endoftext|>"
    assert tokenizer.encode(text, add_special_tokens=False).ids == encoder.encode_ordinary(text)


def test_special_token_in_a_text(spark):
    """The ids are those of the tokenizers library as it comes, also where a text holds its special token."""
    import public_tokenizers

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n <|endoftext|>  y's", "<|endoftext |> <|ENDOFTEXT|> <|endoftext", "none", "é<|endoftext|>😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source").coalesce(1)
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs, *vocabulary()).collect()}
    assert found == {k: [*plain.encode(t, add_special_tokens=False).ids, packing.END] for k, t in enumerate(texts)}
    assert found[0] == [64, 220, 50256, 275, packing.END]


def test_far_more_sources_than_queues(spark, tokenizer):
    """Sources become a bounded number of queues; every id still lies in one place and the large source is in every window."""
    rows = [(k, f"s{k % 1500}" if k % 3 else "large", "word " * (k % 40 + 1)) for k in range(6000)] + [(9000, None, "null source " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    texts = [(k, tokenizer.encode(t, add_special_tokens=False).ids) for k, _, t in rows]
    found = {}
    for most_firsts in (packing.MOST_FIRSTS, 0):
        pieces = packing.pack(docs, *vocabulary(), length=256, window_sequences=8, many=10, most_firsts=most_firsts).collect()
        check(pieces, texts, tokenizer, 256)
        found[most_firsts] = sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in pieces)
    assert found[0] == found[packing.MOST_FIRSTS]
    share = sum(len(ids) + 1 for k, ids in texts if rows[k if k < 6000 else 6000][1] == "large") / sum(len(ids) + 1 for _, ids in texts)
    held = {}
    for r in pieces:
        if r.doc_id % 3 == 0 and r.doc_id != 9000:
            held[r.sequence_id // 8] = held.get(r.sequence_id // 8, 0) + r.n
    assert all(abs(held[w] / 2048 - share) < 0.01 for w in range(max(r.sequence_id for r in pieces) // 8))


def test_queues_of_two_hundred_thousand_sources(spark):
    """What reaches the driver is a few hundred totals, and the places of all sources are gapless within their queue."""
    ids = spark.range(400_000).selectExpr("concat('s', id % 200000) AS queue", "cast(id % 7 AS int) AS part", "id % 50 + 1 AS n")
    firsts, totals, weights = packing._queues(ids, None, packing.MANY)
    assert len(totals) <= 2 * packing.MANY and weights is None and totals.sum() == sum(k % 50 + 1 for k in range(400_000))
    sums = ids.groupBy("queue", "part").sum("n").withColumnRenamed("sum(n)", "n")
    joined = firsts.join(sums, (firsts["of"] == sums["queue"]) & (firsts["of_part"] == sums["part"]))
    by_line = joined.selectExpr("line", "first", "first + n AS stop").groupBy("line").agg({"first": "min", "stop": "max", "*": "count"}).collect()
    assert len(by_line) == len(totals) and all(r["min(first)"] == 0 and r["max(stop)"] == totals[r.line] for r in by_line)
    assert joined.count() == firsts.count() == sums.count()


def test_schedule_of_many_windows():
    """A tree of several levels: windows are full, follow the weights, and any place is found from one path."""
    totals = np.array([1_000_003, 333_331, 77_777, 5, 0, 12_345])
    plan = packing.plan_windows(totals, 100)
    assert plan.levels == 3
    taken = []
    for queue, n in enumerate(totals):
        runs = list(plan.place(queue, 0, int(n)))
        assert sum(run for _, run in runs) == n
        half = [r for start in (0, int(n) // 2) for r in plan.place(queue, start, int(n) // 2 if start == 0 and n > 1 else int(n))]
        assert sum(run for _, run in half) == n
        taken += [(position, run, queue) for position, run in runs]
    taken.sort()
    at = 0
    served = np.zeros(len(totals))
    for position, run, queue in taken:
        assert position == at
        at += run
        served[queue] += run
        if at % 100 == 0:
            assert (abs(served - at * totals / totals.sum()) <= 4).all()
    assert at == totals.sum()


def test_whole_long_texts_have_the_ids_of_the_other_library(docs_folder, spark, tokenizer):
    encoder = packing._encoder(*vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["".join(texts[k : k + 9])[::step] for k in range(0, 60, 10) for step in (1, -1, 3)]
    texts.append(" ".join("漢字かな кириллица عربى हिन्दी 😀👩‍👩‍👧 naïve\u0301 1234567 \r\n\t  end".split(" ") * 500))
    for text in texts:
        assert tokenizer.encode(text, add_special_tokens=False).ids == encoder.encode_ordinary(text)
