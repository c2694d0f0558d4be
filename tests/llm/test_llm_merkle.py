"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoforest.llm import merkle as M
from chronoforest.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
SIZES = {"one": 1, "full": 16, "over": 17, "deep": 257, "Ä": 3}


def rows_of():
    out, at = [], 0
    for name, n in SIZES.items():
        for _ in range(n):
            at += 1
            out.append((at * 7919 % 1009, name, "en", at, f"Text {at} ÄÖ of {name}"))
    out += [(5000 + i, f"s{i}", None, None, f"A{i}") for i in range(20)]
    out += [(None, None, None, None, None), (7, None, "en", 0, ""), (7, None, "en", 0, ""), (7, None, "en", 0, "T"), (None, "one", "x", -3, "UP" * 50_000), (10, "", "de", 2, None)]
    return out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return digest(*map(framed, r[:4]), framed(text))

    def lower(t):
        return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def build(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            out.append(nodes)
        return out

    def sides(tree, i):
        for level in tree[:-1]:
            g = i // 16 * 16
            yield "".join(level[g:i]), "".join(level[i + 1 : g + 16])
            i //= 16

    leaves = [leaf(r, r[4]) for r in rows]
    order = {s: sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i])) for s in {r[1] for r in rows}}
    names = sorted(order, key=lambda s: (s is not None, (s or "").encode()))
    trees = [build([leaves[i] for i in order[s]]) for s in names]
    top = build([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for at, i in enumerate(order[s]):
            path, r = [*sides(trees[k], at), *sides(top, k)], rows[i]
            acc = leaf(r, lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4])
            for a, b in path:
                acc = digest(a, acc, b)
            yield (r[0], leaves[i], trees[k][-1][0], top[-1][0], digest(*(a + b for a, b in path)), acc, acc == top[-1][0])


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


def test_proofs_equal_brute_force(docs):
    got = M.verify(docs.repartition(5), changed=M.tampered(docs)).collect()
    assert ordered(got) == ordered(brute(rows_of()))
    assert {r["verified"] for r in got} == {True, False}


def test_sql(docs):
    c = duckdb.connect()
    c.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    want = c.execute(ORACLE_SQL["op12_merkle"])
    at = [[d[0] for d in want.description].index(n) for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    assert ordered([r[i] for i in at] for r in want.fetchall()) == ordered(brute(rows_of()))


@pytest.fixture(scope="module")
def m(docs):
    return M.manifest(docs)


def test_requests_prune_the_descent(m):
    asked = m.leaves.where("_key % 100 = 7 OR n = 1")
    got = {(r["_key"], r["leaf"]): r for r in M.proofs(m, asked).collect()}
    want = {(r["_key"], r["leaf"]): r for r in M.proofs(m).collect()}
    assert 0 < len(got) < len(want) and all(want[k] == r for k, r in got.items())


def test_records_are_content_addressed(m):
    for r in m.records.collect():
        assert 1 <= len(r["children"]) <= 16 and r["digest"] == digest(*r["children"])
    assert m.records.where(F.col("digest") == m.root).count() == 1
    assert (m.height, m.top) == (3, 2)


def test_small_tables(docs, spark):
    assert M.verify(docs.limit(0)).collect() == []
    for n in (1, 2):
        rows = [(i, "a", None, 1, "X") for i in range(n)]
        extra = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("tree", "rank", "n", "leaf", "digest", "path", "children", "root", "_key", "_source", "subroot", "height")))
        assert ordered(M.verify(extra, changed=M.tampered(extra)).collect()) == ordered(brute(rows))
    same = spark.createDataFrame([(1, "a", "en", 1, "x")] * 300, SCHEMA)
    assert ordered(M.verify(same).collect()) == ordered(brute([(1, "a", "en", 1, "x")] * 300))
