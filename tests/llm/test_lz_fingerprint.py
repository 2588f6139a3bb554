from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glucoframe.llm import lz_fingerprint as lz


def phrases(text: str) -> set[str]:
    """The dictionary parse, one code point at a time."""
    known, start = set(), 0
    for stop in range(1, len(text) + 1):
        if text[start:stop] not in known:
            known.add(text[start:stop])
            start = stop
    return known | ({text[start:]} - {""})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", max_size=80), st.text(alphabet="abé", max_size=80))
def test_parse_and_shared_beginning(text, following):
    parse = lz.Parse()
    parse.run(text)
    assert {text[a:b] for a, b in zip(parse.cuts, parse.cuts[1:])} == phrases(text)
    own, edited, other = lz.edit_pair(text, following)
    half = len(text) // 2
    assert edited == text[: len(text) - half] + following[:half]
    assert np.array_equal(own, lz.fingerprint_of(text)) and np.array_equal(other, lz.fingerprint_of(edited))


def test_likeness_is_the_share_of_common_phrases():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    for length in (20, 200, 4000):
        a = " ".join(rng.choice(words, length))
        b = a[: len(a) // 2] + " ".join(rng.choice(words, length))[: len(a) // 2]
        pa, pb = phrases(a), phrases(b)
        assert abs(lz.likeness(lz.fingerprint_of(a), lz.fingerprint_of(b)) - len(pa & pb) / len(pa | pb)) < (0.16 if len(pa) > lz.KEPT else 0.001)
    assert lz.likeness(lz.fingerprint_of(""), lz.fingerprint_of("")) == 1.0 and lz.likeness(lz.fingerprint_of("a"), lz.fingerprint_of("")) == 0.0


@pytest.mark.parametrize("bucket_rows", [7, 1000])
def test_documents_against_their_neighbours(spark, docs_folder, bucket_rows):
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    found = {r.doc_id: r for r in lz.beside_next(docs.repartition(4), bucket_rows=bucket_rows).collect()}
    assert sorted(found) == [k for k, _ in rows]
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half, r = len(text) // 2, found[doc_id]
        edited = text[: len(text) - half] + after[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        own, other, following = (lz.fingerprint_of(t) for t in (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (lz.as_hex(own), lz.as_hex(other))
        assert (r.near_edited, r.near_next) == (lz.likeness(own, other), lz.likeness(own, following))
        assert np.array_equal(lz.from_hex(r.fingerprint), own)


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_odd_rows(spark, odd_docs, no_docs, bucket_rows):
    rows = lz.beside_next(odd_docs, bucket_rows=bucket_rows).collect()
    assert len(rows) == 12 and sum(r.doc_id is None for r in rows) == 2
    equal = [r for r in rows if r.doc_id in (6, 7)]
    assert equal[0].fingerprint == equal[1].fingerprint and {r.near_next for r in equal if r.doc_id == 6} == {1.0}
    assert all(r.fingerprint == "" for r in rows if r.doc_id in (2, 3))
    assert lz.beside_next(no_docs).count() == 0
    nameless = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert [r.near_next for r in lz.beside_next(nameless, bucket_rows=bucket_rows).collect()] == [1.0]
    one = spark.createDataFrame([(4, "some text")], "doc_id long, text string")
    assert [r.near_next for r in lz.beside_next(one, bucket_rows=bucket_rows).collect()] == [1.0]
    assert len(lz.fingerprints(odd_docs).collect()) == 12
