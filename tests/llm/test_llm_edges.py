"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronoforest.llm import exact_dedup as E
from chronoforest.llm import jpeg as J
from chronoforest.llm import katz as K
from chronoforest.llm import langid as L
from chronoforest.llm import mixing as M
from chronoforest.llm import ngram_join as NJ
from chronoforest.llm import quality as Q
from chronoforest.llm import sentencepiece_lattice as S
from chronoforest.llm import suffix_dedup as SD
from chronoforest.llm import warc as WC

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and looked out", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \n\t ", "en", "b"),
    (5, LONG, "en", "a"),
    (6, LONG, "de", "a"),
    (6, LONG, "de", "a"),
    (7, "das ist ein Haus über dem Fluß ▁ 日本", "de", "b"),
    (None, "12 34 !!", "de", None),
    (9, "the cat sat on the mat and looked out", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("score", "predicted", "held_out", "slot", "rank", "block", "n", "keep_id", "kept", "group_size", "ticks", "rid", "doc", "node", "component", "key", "h", "_key", "_text", "sample", "ids", "seq", "payload", "record_id", "_sha", "media", "gram", "pos", "bucket", "kind", "y", "x", "_h", "_slot", "u", "v")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, None, 1), (9, 1, 0), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_jpeg(docs, none):
    got = J.text_media(docs, keep_media=True).collect()
    assert len(got) == len(ROWS)
    for r, (_, text, _, _) in zip(got, ROWS, strict=True):
        raw = (text or "").encode()
        p = J.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["media"]) == r["media_bytes"]
    assert len({r["feature"] for r in got if r["n_bytes"] == len(LONG)}) == 1
    assert J.text_media(none).count() == 0
    plain = [c for c in got[0].asDict() if c not in ("media", "rgb")]
    assert sorted(map(str, J.text_media(docs).collect())) == sorted(str(Row(**{c: r[c] for c in plain})) for r in got)
    bad = docs.select("doc_id", F.lit(b"\xff\xd8nonsense").alias("media")).unionByName(docs.select("doc_id", F.lit(None).cast("binary").alias("media")))
    assert J.decode_media(bad, "doc_id").where("error IS NULL").count() == 0


def test_suffix(docs, none):
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in SD.repeated_passages(docs).collect()}
    assert got == {(5, 0, 30_000), (6, 0, 30_000)}
    assert SD.repeated_passages(none).count() == 0


def test_mixing(docs, none):
    got = M.mix_sources(docs, block=1).collect()
    assert len(got) == len(ROWS) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    w = M.mix_sources(docs, weights={"a": 1, "b": 1}, block=1).collect()
    assert len(w) == len(ROWS) and sum(r["selected"] for r in w) == 4 and all(not r["selected"] for r in w if r["source"] == "")
    assert M.mix_sources(none).count() == 0


def test_mixing_many_sources(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 40).alias("source"))
    got = M.mix_sources(docs, block=2).collect()
    assert len(got) == 400 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_quality(docs, none, labels, spark):
    got = Q.quality_scores(docs, labels)
    assert sorted(got.columns) == sorted([c for c in docs.columns])
    assert got.count() == len(ROWS) and got.where("score BETWEEN 0 AND 1 AND predicted = cast(score >= 0.3 AS int)").count() == len(ROWS)
    assert len({(r["text"], r["score"]) for r in got.collect()}) == 7
    assert Q.quality_scores(none, labels).count() == 0
    assert Q.quality_scores(docs, labels.limit(0)).where("predicted = 1").count() == len(ROWS)


def test_katz(docs, none):
    got = K.katz_scores(docs)
    assert got.count() == len(ROWS) and got.where("score <= 0 AND base_score <= 0 AND n_tokens >= 1 AND isnotnull(held_out)").count() == len(ROWS)
    assert {r["n_tokens"] for r in got.where("doc_id IN (2, 3, 4)").collect()} == {1}
    assert K.katz_scores(none).count() == 0
    only = K.katz_scores(docs.where("crc32(cast(doc_id AS string)) % 5 = 1"))
    assert only.where("score != 0").count() == 0 and only.count() > 0


def test_ngram(docs, none):
    got = NJ.jaccard_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got if r["doc_id"] is not None) == sorted([("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5), ("6", 5), ("6", 5), ("7", 7), ("9", 1)])
    assert {r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 4)} == {0} and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert NJ.jaccard_components(none).count() == 0


def test_langid(docs, none):
    got = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in L.identify(docs).collect()}
    assert {got[k] for k in ("2", "3", "4", "None")} == {("und", 0.0)} and got["7"][0] in ("en", "de")
    assert L.identify(none).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("bits", [64, 2, 1])
def test_exact(docs, none, bits):
    """With one or two bits of hash most texts share a chain and only their bytes tell them apart."""
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(docs, capacity=1, bits=bits).collect()]
    assert set(got) == {(1, 9, 2, False), (9, 9, 2, True), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True), (None, None, 1, True)}
    assert len(got) == len(ROWS) and E.exact_dedup(none, bits=bits).count() == 0


def test_exact_small_buckets(spark):
    """The directory doubles several times, and the plan's exchange of texts is by bucket alone."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1700).cast("string")).alias("text"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_dedup(docs, capacity=7, hot_share=10**6).collect()}
    keep = lambda i: i + 1700 if i + 1700 < 3000 else i
    assert got == {i: (keep(i % 1700), 1 + (keep(i % 1700) != i % 1700), i == keep(i % 1700)) for i in range(3000)}


def test_directory(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    slots, top = E.directory(hashes, 310)
    d = {r["slot"]: r["depth"] for r in slots.collect()}
    sizes = {}
    for r in hashes.select(E.prefix(top).alias("s")).collect():
        k = (d[r["s"]], r["s"] >> (top - d[r["s"]]))
        sizes[k] = sizes.get(k, 0) + 1
    assert max(sizes.values()) <= 310 and sum(sizes.values()) == 20_000 and len({depth for depth, _ in sizes}) > 1
    # a bucket's parent would have been too full: no split without need
    parents = {}
    for (depth, p), n in sizes.items():
        parents[(depth - 1, p >> 1)] = parents.get((depth - 1, p >> 1), 0) + n
    assert all(n > 310 for (depth, p), n in parents.items() if all((depth + 1, 2 * p + i) in sizes for i in (0, 1)))
    # 3,000 hashes that differ in their last 12 bits only: the directory goes on to the bits that tell them apart
    slots, top = E.directory(spark.range(3000).select("id").withColumnRenamed("id", "h"), 100)
    assert top > 56 and slots.where("depth > 56").count() > 0


@pytest.mark.parametrize("chunk", [400, 256 << 10])
def test_warc(docs, none, chunk):
    pages = docs.withColumn("url", F.when(F.col("doc_id") != 4, F.concat(F.lit("http://x/\r\n"), "doc_id")))
    got = WC.warc_records(pages, key="doc_id", payload="text", chunk_bytes=chunk).collect()
    assert len(got) == len(ROWS) and all(r["ok"] for r in got)
    kinds = {(r["record_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(1, "revisit", 9), (9, "response", None), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "revisit", 6), (6, "response", None), (7, "response", None), (None, "response", None)}
    assert {r["payload_bytes"] for r in got if r["record_id"] in (5, 6)} == {len(LONG)}
    small = WC.warc_records(pages, key="doc_id", payload="text", min_bytes=1).where("record_id IN (2, 3)")
    assert {r["record_type"] for r in small.collect()} == {"response"}
    assert WC.warc_records(pages.limit(0), key="doc_id", payload="text").count() == 0


def test_sentencepiece(docs, none):
    got = S.sample_segmentations(docs, k=3).collect()
    assert all(r["exact"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["sample"]), set()).add(tuple(r["ids"]))
    assert by[(2, 0)] == {()} and (2, 1) not in by and all(len(v) == 1 for v in by.values())
    assert all(by[(d, 0)] != by[(d, 1)] for d in (1, 5, 6, 7, 9))
    texts = {d: t or "" for d, t, _, _ in ROWS}
    back = S.decode_ids(S.sample_segmentations(docs.where("doc_id IN (1, 7)")))
    assert all(r["decoded"] == texts[r["doc_id"]] for r in back.collect())
    assert S.sample_segmentations(none).count() == 0
    with pytest.raises(ValueError):
        S.sample_segmentations(docs, k=0)


def test_tree_pairs_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.poisson(6, (60, 32))
    pts = np.maximum(0, np.concatenate([base + rng.integers(-1, 2, base.shape) for _ in range(15)]))
    size, group = pts.sum(1), rng.integers(0, 4, len(pts))
    got = {tuple(sorted(p)) for i, j in NJ.tree_pairs(pts, size, group, 90) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if group[i] != group[j] and np.minimum(pts[i], pts[j]).sum() >= NJ.needed(size[i], size[j], 90)}
    assert got == want and len(want) > 100
