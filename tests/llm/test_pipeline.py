"""The pipeline's stages on the smallest tables, each against its operator's meaning on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(steps):
    assert [n for n, _, _ in steps] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_quality_keeps_the_good(steps, spark, sf):
    _, before, after = steps[0]
    kept = {r["doc_id"] for r in after.collect()}
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(k in kept, v) for k, v in lab.items()]
    assert sum(k == bool(v) for k, v in seen) >= 0.95 * len(seen)


def test_exact(steps):
    _, before, after = steps[1]
    best = {}
    for r in before.collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(best.values()) == sorted(r["doc_id"] for r in after.collect())


def test_near(steps):
    from test_llm_methods import linked_components, lower

    _, before, after = steps[2]
    comp = linked_components({r["doc_id"]: lower(r["text"]) for r in before.collect()}, 5, 80)
    groups = defaultdict(list)
    for k, (_, c) in comp.items():
        groups[c].append(k)
    assert sorted(min(g) for g in groups.values()) == sorted(r["doc_id"] for r in after.collect())


def test_mixing_and_segments(steps):
    from test_llm_methods import mixture

    _, before, after = steps[3]
    sizes = Counter(r["source"] for r in before.collect())
    want, _ = mixture(sizes, P.TARGET_SHARE, 16)
    assert Counter(r["source"] for r in after.collect()) == want
    _, docs, segs = steps[4]
    assert segs.where("NOT exact").count() == 0
    assert segs.where("sample = 0").count() == docs.count()
    assert not re.search("text", " ".join(segs.columns))


def test_mixing_cuts_a_large_source(spark, sf):
    from test_llm_methods import mixture

    sizes = {"a": 5000, "b": 300, "c": 300, "d": 200, "e": 200}
    docs = spark.createDataFrame([(i * 10 + j, f"t{i}", s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, text string, source string")
    want, _ = mixture(sizes, P.TARGET_SHARE, 16)
    got = Counter(r["source"] for r in P.mixing(spark, docs, sf).collect())
    assert got == want and got["a"] < 500 and got["b"] == 300


WORDS = " ".join(f"w{i}" for i in range(60))
EDGES = [
    (1, WORDS, "en", "a"),
    (5, WORDS + " end", "en", "a"),  # near copy of 1 under an id that has another text too
    (5, "an unrelated text that nobody else has", "en", "b"),
    (6, "same under one id", "en", "a"),
    (6, "same under one id", "en", "a"),
    (None, "an orphan with words of its own", "en", None),
    (None, WORDS, None, "a"),
    (7, None, "en", "b"),
    (8, "", "en", "b"),
    (9, WORDS.replace("w30", "x30"), "en", "a"),
]


@pytest.fixture(scope="module")
def edges(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    return docs.select("*", *(F.lit("clash").alias(c) for c in ("score", "predicted", "kept", "selected", "_key", "_text", "component_id", "slot", "n", "doc", "node", "h", "text_sha256", "rank")))


def test_stages_decide_on_rows(edges, spark, sf):
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    every = [(k, t) for k, t, _, _ in EDGES]
    got = rows(P.exact(spark, edges, sf))
    assert got == sorted([r for r in set(every) if r not in ((None, WORDS), (7, None))], key=str)
    got = rows(P.near(spark, edges, sf))
    assert got == sorted([r for r in every if r not in ((None, WORDS), (5, WORDS + " end"), (9, EDGES[9][1]))], key=str)
    assert rows(P.mixing(spark, edges, sf)) == sorted(every, key=str)
    assert set(rows(P.quality(spark, edges, sf))) <= set(every)
    segs = P.segments(spark, edges, sf)
    assert segs.where("sample = 0").count() == len(EDGES) and segs.where("NOT exact").count() == 0


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages_on_an_empty_table_and_extra_columns(edges, spark, sf, name, stage):
    out = stage(spark, edges.limit(0), sf)
    assert out.count() == 0 and (name == "sentencepiece" or out.columns == edges.columns)
    if name != "sentencepiece":
        kept = stage(spark, edges, sf)
        assert kept.columns == edges.columns and kept.where("score != 'clash' OR kept != 'clash' OR selected != 'clash'").count() == 0


def test_run_gives_the_same_rows(steps, spark, sf):
    want = sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in steps[-1][2].collect())
    got = sorted((r["doc_id"], r["sample"], tuple(r["ids"])) for r in P.run(spark, sf).collect())
    assert got == want
