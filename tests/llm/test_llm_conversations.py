"""Conversation repair against a search over edits, row by row."""

import hashlib
import heapq
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoforest.llm import conversations as C
from chronoforest.llm.queries import ORACLE_SQL

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = set(" \t\n\x0b\x0c\r")
WANTED, TO, NAME = "uuau", (2, 2, 3, 2), {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, rows left) of rows (initial, must go, truncated, role, text): the first found of least (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, out = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            return cost, audit, out
        name = NAME[WANTED[s]]
        heapq.heappush(heap, (cost + 2, audit + "I", i, TO[s], (*out, (name, ""))))
        if i < len(rows):
            initial, gone, cut, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, out))
            if not gone:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, TO[s], (*out, (name, text))))
                if initial == WANTED[s]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, TO[s], (*out, (role, text))))
                if initial == "s" and s == 0:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, 1, (*out, (role, text))))


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        here = convs.setdefault(conv, [])
        if kind == 0:
            continue
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        role = "user" if kind == 4 else role
        tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        here += [((turn is not None, turn or 0, role, tie), turn, role, text)] * (2 if kind == 3 else 1)
    for conv, here in convs.items():
        here.sort(key=lambda x: x[0])
        seen, faults, marked = set(), [], []
        for _, _, role, text in here:
            body = [c for c in text if c not in SPACE]
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role[:1], faults[-1] in ("b", "d"), faults[-1] == "t", role, text))
        turns = [t for _, t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, out = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in out)
        yield (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def rows_of():
    rng = random.Random(11)
    out = []
    for conv in range(160):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "uncle"])
            text = rng.choice(["Yes.", "No!", "Well?  \n", "cut off", "", " \t\r\n\x0b", None, "x.", "Über 日本。", "a ", "word " * 20 + "."])
            out.append((conv, rng.choice([turn, turn, turn, None, turn + 3, 0]), role, text))
    out += [(None, None, None, None), (None, 1, "user", "q?"), (None, 1, "user", "q?"), (-5, -2, "user", "a."), (-5, -9, "assistant", "b.")]
    out += [(900, 1, "user", "word " * 700_000 + "end."), (900, 2, "assistant", "ok.")]
    out += [(901, i, ("user", "assistant", "system")[i * i % 3], f"t{i % 40}{'.' * (i % 5 > 0)}") for i in range(3000)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(6)


def test_repair_equals_search(rows):
    got, want = ordered(C.repair(rows, damage=C.damaged).collect()), ordered(brute(rows_of()))
    assert got == want
    assert any(r[7] == "" for r in got) and any("DI" in r[7] for r in got)


def test_sql(spark):
    plain = [r for r in rows_of() if r[0] not in (900, 901)] + [(7000 + i, i, "user", "x.") for i in range(40)]
    c = duckdb.connect()
    c.register("conversations", spark.createDataFrame(plain, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    found = c.execute(ORACLE_SQL["op11_conversations"])
    assert [d[0] for d in found.description] == ["conv_id", *C.COUNTS, "cost", "audit", "repaired_sha256"]
    assert ordered(found.fetchall()) == ordered(brute(plain))


def test_all_short_signatures():
    symbols = "xsuaoSUAO"
    every = [s for n in range(5) for s in itertools.product(symbols, repeat=n)]
    every.sort(key=lambda s: s[::-1])
    walk, made = C.Walk(), 0
    for s in every:
        made += len(s) - walk.to("".join(s))
        cost, audit, _ = cheapest([(x.lower(), x == "x", x.isupper(), "", "") for x in s])
        assert walk.result() == (cost, audit), s
    # a node for each suffix, and far fewer classes
    assert made == len(every) - 1 and len(walk.suffixes.classes) < 100


def test_automaton_has_each_suffix_once(spark):
    rng = random.Random(2)
    signatures = {"".join(rng.choices("xuaU", k=rng.randint(0, 8))) for _ in range(400)}
    got = C.suffix_nodes(spark.createDataFrame([(s,) for s in signatures] * 2, "signature string")).collect()
    suffixes = {s[i:] for s in signatures for i in range(len(s) + 1)}
    nodes = {r["node"]: r for r in got}
    assert len(got) == len(nodes) == len(suffixes)
    for s in signatures:
        node = hashlib.sha256(b"").hexdigest()
        for symbol in reversed(s):
            node = hashlib.sha256(f"{symbol}{node}".encode()).hexdigest()
        cost, audit, _ = cheapest([(x.lower(), x == "x", x.isupper(), "", "") for x in s])
        assert nodes[node]["costs"][C.START] == cost and audit.startswith(nodes[node]["edits"][C.START])


def test_repaired_rows(spark):
    plain = [(1, 0, "assistant", "hello."), (1, 1, "user", "q?"), (2, 0, "system", "s."), (2, 1, "user", "q"), (2, 2, "user", "q"), (2, 3, "assistant", "a."), (3, 0, "user", " ")]
    got = [tuple(r) for r in C.repaired_rows(spark.createDataFrame(plain, SCHEMA)).orderBy("conv_id", "place").collect()]
    # all rows of 1 may go for 6; an inserted user's row and an assistant's behind cost 4
    assert got == [
        (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "hello."), (1, 3, "K", "user", "q?"), (1, 4, "I", "assistant", ""),
        (2, 1, "K", "system", "s."), (2, 2, "K", "user", "q"), (2, 3, "K", "assistant", "a."),
    ]


def test_small_tables(spark, rows):
    assert C.repair(rows.limit(0), damage=C.damaged).collect() == []
    names = ("conv", "head", "live", "copy", "copies", "symbol", "signature", "audit", "cost", "same", "_end", "_place", "mark", "time", "place", "gaps")
    one = spark.createDataFrame([(5, 1, "user", "q?")], SCHEMA).select("*", *(F.lit(1).alias(c) for c in names))
    assert ordered(C.repair(one, damage=C.damaged).collect()) == ordered(brute([(5, 1, "user", "q?")]))
    common = [(i, t, r, x) for i in range(500) for t, r, x in ((0, "user", "q?"), (1, "assistant", "a."))]
    assert ordered(C.repair(spark.createDataFrame(common, SCHEMA), damage=C.damaged).collect()) == ordered(brute(common))
