"""Multiset fingerprints against plain Python: edited texts, sums of paragraph vectors, ranges and edges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoforest.llm import multiset_hash as M

WORDS = "ere the anle ouwh Ñeque über ▁日本 stion 𝔘x no".split()
SCHEMA = "doc_id long, text string"


def some_text(rng):
    return rng.choice(["\n", "\n\n", " ", "\r\n"]).join(" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 7)))


def rows_of():
    rng = random.Random(7)
    out = [(i * 37 % 401, some_text(rng)) for i in range(401)]
    out += [(1000, None), (1001, ""), (1002, "a"), (1003, "ab"), (1004, "\n"), (1005, "x\n\n"), (None, "last one"), (None, "last two"), (5, "a second five"), (5, "a second five"), (-3, "𝔘" * 9)]
    out += [(2000, "word " * 700_000), (2001, "line of text\n" * 90_000)]
    return out


def vector(text):
    return sum((M.text_vector(p).astype(np.int64) for p in text.split("\n")), np.zeros(M.LANES, np.int64)).astype(np.uint32)


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(7)


def test_paragraph_vector():
    v = M.text_vector("One two three four")
    assert (v[: M.EXACT] == np.frombuffer(hashlib.shake_128(b"One two three four").digest(4 * M.EXACT), "<u4")).all()
    assert np.abs(v[M.EXACT :].astype(np.int32)).sum() == 2  # two shingles
    assert (v[M.EXACT :] == M.text_vector("one TWO three four")[M.EXACT :]).all()
    assert np.abs(M.text_vector("one two")[M.EXACT :].astype(np.int32)).sum() == 1
    for text in ("", "\n", "a\nb c d e\n\nf", "x y z\n" * 5):
        assert (M.text_vector(text) == vector(text)).all()


def test_order_insertion_and_deletion():
    a, b, c = "first part here", "second part over there", "third"
    assert (M.text_vector(f"{a}\n{b}\n{c}") == M.text_vector(f"{c}\n{a}\n{b}")).all()
    assert (M.text_vector(f"{a}\n{b}\n{c}") - M.text_vector(b) == M.text_vector(f"{a}\n{c}")).all()
    assert (M.text_vector(f"{a}\n{a}") != M.text_vector(a)).any()


@pytest.mark.parametrize("limit", [M.SLICE_BYTES, 500])
def test_fingerprints_equal_brute_force(docs, limit):
    got = M.fingerprints(docs, limit=limit).collect()
    rows = rows_of()
    assert len(got) == len(rows)
    order = sorted([(i is None, -(i or 0), t or "") for i, t in rows])
    texts, seen = {}, {}
    for _, i, t in order:
        texts.setdefault(i, []).append(t)
    for r in got:
        seen.setdefault(-(r["doc_id"] or 0), []).append(r)
    alone = [(-i, t[0]) for i, t in texts.items() if len(t) == 1]
    first, at = order[0][2], [i for _, i, _ in order]
    for i, text in alone:
        (r,) = seen[-i]
        k = at.index(-i)
        after = order[k + 1][2] if k + 1 < len(order) else first
        if len(texts[order[(k + 1) % len(order)][1]]) > 1:  # its next is one of several
            continue
        e = edited(text, after)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        if len(text) < 10_000:
            x, y, z = vector(text), vector(e), vector(after)
            assert (M.decoded(r["fingerprint"]) == x).all() and (M.decoded(r["edited_fingerprint"]) == y).all()
            assert r["near_edited"] == M.likeness(x[None], y[None])[0] and r["near_next"] == M.likeness(x[None], z[None])[0]
    # rows that share a key: each follows another, whichever comes first
    for i, several in texts.items():
        if len(several) > 1:
            assert sorted(M.encoded(vector(t)) for t in several) == sorted(r["fingerprint"] for r in seen[i])


def test_equal_texts_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}\nin two lines") for i in range(70)], SCHEMA)
    got = M.fingerprints(docs).join(docs, "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"), F.first("fingerprint").alias("f")).collect()
    assert [r["n"] for r in got] == [1] * 7 and len({r["f"] for r in got}) == 7


def test_likeness_tells_halves_apart(spark):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randint(0, 9999)) for _ in range(400)) for _ in range(60)]
    got = M.fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert all(0.35 < r["near_edited"] < 0.65 and r["near_next"] < 0.2 for r in got)
    same = M.fingerprints(spark.createDataFrame([(i, texts[0]) for i in range(9)], SCHEMA)).collect()
    assert {r["near_next"] for r in same} == {1.0} and len({r["fingerprint"] for r in same}) == 1


def test_small_tables(spark, docs):
    assert M.fingerprints(docs.limit(0)).collect() == []
    (r,) = M.fingerprints(spark.createDataFrame([(1, "abcd")], SCHEMA).select("*", *(F.lit(0).alias(c) for c in ("_k", "_h", "_at", "_to", "_range", "_guest", "fingerprint", "n_chars")))).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0
    same = M.fingerprints(spark.createDataFrame([(4, "a b")] * 300, SCHEMA)).collect()
    assert len(same) == 300 and {r["near_next"] for r in same} == {1.0}


def test_ranges_cover_all(spark):
    cuts = [(-9, 0), (-9, 5), (0, 1), (7, 7)]
    rows = spark.createDataFrame([(-9, 0), (-9, 4), (-9, 5), (-1, 0), (0, 0), (0, 1), (7, 7), (99, 0)], "k long, h long")
    at, _, _ = M._range_of(cuts, F.col("k"), F.col("h"))
    assert [r["at"] for r in rows.select(at.alias("at")).collect()] == [0, 0, 1, 1, 1, 2, 3, 3]


def test_updates(spark):
    prints = spark.createDataFrame([(1, M.encoded(M.text_vector("a b c\nd"))), (2, M.encoded(M.text_vector("x")))], "doc_id long, fingerprint string")
    changes = spark.createDataFrame([(1, "d", False), (1, "new text here", True), (3, "z", True), (2, None, True)] + [(1, "many", True)] * 50, "doc_id long, paragraph string, inserted boolean")
    got = {r["doc_id"]: M.decoded(r["fingerprint"]) for r in M.updated(prints, changes.repartition(6)).collect()}
    assert (got[1] == M.text_vector("a b c\nnew text here" + "\nmany" * 50)).all()
    assert (got[2] == M.text_vector("x\n")).all() and (got[3] == M.text_vector("z")).all() and len(got) == 3
