"""The operators against brute force, exact round trips and held-out accuracy."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoforest.llm import jpeg as J
from chronoforest.llm import sentencepiece_lattice as S
from chronoforest.llm.katz import K, Unigrams, discounts
from chronoforest.llm.queries import ORACLE_SQL, QUERIES
from chronoforest.llm.textcore import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: lower(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rank_codes():
    lengths = {s: 8 if s < 128 else 9 for s in range(255)}
    return J.canonical(lengths)


class Bits:
    def __init__(self):
        self.out = []

    def put(self, v, n):
        self.out += [(v >> (n - 1 - i)) & 1 for i in range(n)]

    def data(self):
        b = self.out + [1] * (-len(self.out) % 8)
        raw = bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def magnitude(v):
    s = abs(v).bit_length()
    return s, v if v >= 0 else v + (1 << s) - 1


def scalar_jpeg(width, height, parts, rng_restart=0):
    """A plain progressive encoder after the standard's flow charts; parts: (h, v, blocks rows x cols x 64) a component."""
    codes, body = rank_codes()
    hm, vm = max(p[0] for p in parts), max(p[1] for p in parts)
    ax, ay = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = [b"\xff\xd8", J.segment(0xDB, b"\x00" + bytes([3] * 64)), J.segment(0xC4, b"\x00" + body + b"\x10" + body), J.segment(0xC2, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(parts)))]
    order = [(c, my * v + y, mx * h + x) for my in range(ay) for mx in range(ax) for c, (h, v, _) in enumerate(parts) for y in range(v) for x in range(h)]
    head = lambda ids, lo, hi, ah, al: J.segment(0xDA, bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([lo, hi, ah << 4 | al]))
    w, pred = Bits(), [0] * len(parts)
    for c, y, x in order:
        d = int(parts[c][2][y, x, 0]) >> 1
        s, bits = magnitude(d - pred[c])
        pred[c] = d
        w.put(*codes[s])
        w.put(bits, s)
    out += [head(range(len(parts)), 0, 0, 0, 1), w.data()]
    w = Bits()
    for c, y, x in order:
        w.put(int(parts[c][2][y, x, 0]) & 1, 1)
    out += [head(range(len(parts)), 0, 0, 1, 0), w.data()]
    for c, (h, v, blocks) in enumerate(parts):
        bw, bh = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        seq = [blocks[y, x] for y in range(bh) for x in range(bw)]
        for lo, hi in ((1, 9), (10, 63)):
            w, run = Bits(), 0

            def flush(w=None, run=0):
                if run:
                    r = run.bit_length() - 1
                    w.put(*codes[r << 4])
                    w.put(run - (1 << r), r)

            for b in seq:
                zeros = 0
                for k in range(lo, hi + 1):
                    a = int(math.copysign(abs(int(b[k])) >> 1, int(b[k])))
                    if not a:
                        zeros += 1
                        continue
                    flush(w, run)
                    run = 0
                    while zeros > 15:
                        w.put(*codes[0xF0])
                        zeros -= 16
                    s, bits = magnitude(a)
                    w.put(*codes[zeros << 4 | s])
                    w.put(bits, s)
                    zeros = 0
                run += zeros > 0
            flush(w, run)
            out += [head([c], lo, hi, 0, 1), w.data()]
        w, run, held = Bits(), 0, []
        for b in seq:
            mags = [abs(int(x)) for x in b]
            last = max((k for k in range(1, 64) if mags[k] == 1), default=0)
            zeros, fix = 0, []
            for k in range(1, 64):
                if mags[k] == 0:
                    zeros += 1
                    continue
                while zeros > 15 and k <= last:
                    flush(w, run)
                    w.out += held
                    run, held = 0, []
                    w.put(*codes[0xF0])
                    w.out += fix
                    fix, zeros = [], zeros - 16
                if mags[k] > 1:
                    fix.append(mags[k] & 1)
                    continue
                flush(w, run)
                w.out += held
                run, held = 0, []
                w.put(*codes[zeros << 4 | 1])
                w.put(int(b[k] > 0), 1)
                w.out += fix
                fix, zeros = [], 0
            if zeros or fix:
                run += 1
                held += fix
        flush(w, run)
        w.out += held
        out += [head([c], 1, 63, 1, 0), w.data()]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("seed", range(4))
def test_jpeg_decoder_on_a_plain_encoder(seed):
    rng = np.random.default_rng(seed)
    width, height = (int(x) for x in rng.integers(5, 70, 2))
    shapes = [(2, 2), (1, 1), (1, 1)] if seed % 2 else [(2, 1), (1, 1), (1, 1)]
    hm, vm = 2, shapes[0][1]
    ax, ay = -(-width // (8 * hm)), -(-height // (8 * vm))
    parts = []
    for h, v in shapes:
        b = rng.integers(-60, 61, (ay * v, ax * h, 64))
        b[rng.random(b.shape) < (0.5, 0.97, 0.85, 0.2)[seed]] = 0
        b[rng.random(b.shape) < 0.05] = 1
        b[rng.random(b.shape[:2]) < 0.3, 1:] = 0
        parts.append((h, v, b))
    data = scalar_jpeg(width, height, parts)
    other = J.encode_payloads([J.padded(b"side by side" * 99)])[0]
    ims = [J.Image(data), J.Image(other)]
    got, side = J.decode_coefficients(ims, [data, other])
    for (h, v, b), g in zip(parts, got, strict=True):
        bw, bh = -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)
        assert (g[:bh, :bw] == b[:bh, :bw]).all()
    assert J.payload_of(ims[1], side) == J.padded(b"side by side" * 99)
    rgb = J.rgb_tensor(ims[0], got)
    assert rgb.shape == (height, width, 3)
    # a float inverse transform of the first luma block, with its chroma neighbours repeated
    i = np.arange(8)
    one = np.where(i == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * i[None] + 1) * i[:, None] * np.pi / 16) / 2
    plain = np.zeros((3, 8, 8))
    for c in range(3):
        f = np.zeros(64)
        f[J.ZIGZAG] = parts[c][2][0, 0] * 3
        plain[c] = np.clip(np.round(one.T @ f.reshape(8, 8) @ one) + 128, 0, 255)
    y = plain[0]
    cb, cr = (plain[c].repeat(vm, 0).repeat(hm, 1)[:8, :8] - 128 for c in (1, 2))
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    n, m = min(8, height), min(8, width)
    assert np.abs(rgb[:n, :m].astype(float) - want[:n, :m]).max() <= 4


def test_jpeg_holds_every_byte_at_all_lengths():
    rng = np.random.default_rng(3)
    pay = [bytes(range(256)) * 3, *(rng.integers(0, 256, n, np.uint8).tobytes() for n in (1, 63, 64, 65, 383, 384, 385, 4097, 70_000)), b" " * 192, b"\xff" * 999]
    files = J.encode_payloads(pay)
    images = [J.Image(f) for f in files]
    assert [J.payload_of(i, c) for i, c in zip(images, J.decode_coefficients(images, files), strict=True)] == pay
    alone = J.decode_coefficients(images[:1], files[:1])[0]
    assert J.payload_of(images[0], alone) == pay[0]


def test_jpeg_query(spark, sf):
    import hashlib

    got = {r["doc_id"]: r for r in QUERIES["op1_jpeg"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        p = J.padded((r["text"] or "").encode())
        assert (got[r["doc_id"]]["payload_sha256"], got[r["doc_id"]]["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_suffix_query_against_all_windows(spark, sf, texts):
    where = defaultdict(set)
    words = {k: WORD.findall(t) for k, t in texts.items()}
    for k, w in words.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    want = set()
    for k, w in words.items():
        runs = []
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + 50
                else:
                    runs.append([i, i + 50])
        want |= {(k, a, b) for a, b in runs}
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()}
    assert got == want and want


@pytest.mark.parametrize("limit", [{}, {"group_rows": 7}])
def test_suffix_runs_of_one_word(spark, limit):
    """Runs of one word of all lengths and phases, alone, after and before other words, against all windows."""
    from chronoforest.llm import suffix_dedup as SD

    rng = np.random.default_rng(2)
    rows = []
    for n in [*range(38, 64), 91, 100, 130, 700]:
        lead, tail = (int(x) for x in rng.integers(0, 30, 2))
        shared = [f"s{j}" for j in range(60)]
        head, foot = (shared[60 - lead :], shared[:tail]) if n % 3 else ([f"a{n}x{j}" for j in range(lead)], [])
        rows.append((n, " ".join([*head, *["x"] * n, *foot])))
    holders = defaultdict(set)
    for d, text in rows:
        w = text.split()
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    want = {(d, j) for d, text in rows for i in range(len(text.split()) - 49) if len(holders[tuple(text.split()[i : i + 50])]) > 1 for j in range(i, i + 50)}
    got = SD.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), **limit).collect()
    assert {(r["doc_id"], j) for r in got for j in range(r["start_word"], r["end_word"])} == want


@pytest.mark.parametrize("limit", [{}, {"group_rows": 7}])
def test_suffix_partners_far_apart(spark, limit):
    """Many documents hold a line of 42 words; two also share the words before it, and sort far from each other."""
    from chronoforest.llm import suffix_dedup as SD

    rng = np.random.default_rng(5)
    docs = []
    for t in range(12):
        line, lead = ([f"{kind}{t}x{i}" for i in range(n)] for kind, n in (("line", 42), ("lead", 14 + t)))
        for j in range(80):
            tail, head = ([f"w{i}" for i in rng.integers(0, 10**6, 20)] for _ in range(2))
            docs.append((len(docs), " ".join(head + (lead if j in (10, 60) else []) + line + tail)))
    holders = defaultdict(set)
    for d, text in docs:
        w = text.split()
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    want = {d for v in holders.values() if len(v) > 1 for d in v}
    assert len(want) == 24
    got = SD.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), **limit).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(d, 20, 20 + 42 + 14 + d // 80) for d in want}


SCALE = 1 << 40


@pytest.mark.parametrize(("n", "weights"), [(100_000, {"a": 1.0, "b": 2.0}), (20_000, {f"s{i}": i + 1.0 for i in range(8)}), (20_000, {"a": 0.3, "b": 0.3, "c": 0.4, "d": 1e-4})])
def test_mixing_deviation_stays_below_a_block(spark, n, weights):
    """On a hundred thousand slots, as on any number."""
    from chronoforest.llm.mixing import mix_sources

    total = sum(weights.values())
    parts = [(s, math.ceil(n * w / total) + 1) for s, w in weights.items()]
    rows = spark.createDataFrame(parts, "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS i").selectExpr("xxhash64(source, i) AS doc_id", "source")
    out = mix_sources(rows, weights=weights, block=1, most_slots=1 << 18).where("selected").select("slot", "source", "release", "deadline").toPandas()
    assert ((out.release <= out.slot) & (out.slot < out.deadline)).all()
    out = out.sort_values("slot")
    slots = np.arange(1, len(out) + 1)
    assert len(out) >= n - 10 and (out.slot.to_numpy() == slots - 1).all()
    for s, w in weights.items():
        assert np.abs((out.source.to_numpy() == s).cumsum() - slots * w / total).max() < 1


def test_mixing_deviation_of_sized_sources(spark):
    """Shares by size and held to a quarter, on 40,000 slots."""
    from chronoforest.llm.mixing import mix_sources

    sizes = {"a": 50_000, "b": 11_113, "c": 9_001, "d": 7_000, "e": 3_333, "f": 1}
    rows = spark.createDataFrame(list(sizes.items()), "source string, n int").selectExpr("source", "explode(sequence(1, n)) AS i").selectExpr("xxhash64(source, i) AS doc_id", "source")
    out = mix_sources(rows, max_share=0.25, block=1, most_slots=1 << 18).where("selected").select("slot", "source").toPandas().sort_values("slot")
    slots = np.arange(1, len(out) + 1)
    rest = {s: n for s, n in sizes.items() if s != "a"}
    # b is above a quarter of what a leaves: it is held as well
    left = {s: n for s, n in rest.items() if s != "b"}
    target = {"a": 0.25, "b": 0.25} | {s: n / sum(left.values()) * 0.5 for s, n in left.items()}
    if max(v for s, v in target.items() if s not in "ab") > 0.25:
        left.pop("c")
        target = {"a": 0.25, "b": 0.25, "c": 0.25} | {s: n / sum(left.values()) * 0.25 for s, n in left.items()}
    for s, w in target.items():
        assert np.abs((out.source.to_numpy() == s).cumsum() - slots * w).max() < 1
    assert all((out.source == s).sum() == n for s, n in left.items())


def mixture(sizes, max_share, block, most_slots=1 << 14):
    """Rows of each source in the mixture, by rule: shares of blocks, ticks, simulated slots, the end of the sized sources."""
    block, k = max(block, -(-sum(sizes.values()) // most_slots)), len(sizes)
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    cap, held = max(max_share, 1 / k), set()
    while len(held) < k - 1:
        rest = sum(n for s, n in blocks.items() if s not in held)
        first = min((s for s in blocks if s not in held), key=lambda s: (-blocks[s], s))
        if blocks[first] * (1 - len(held) * cap) <= cap * rest:
            break
        held.add(first)
    rest = sum(n for s, n in blocks.items() if s not in held)
    x = {s: (cap if s in held else n / rest * (1 - len(held) * cap)) * (SCALE - k) for s, n in blocks.items()}
    ticks = {s: 1 + math.floor(v) for s, v in x.items()}
    for s in sorted(x, key=lambda s: (-(x[s] - math.floor(x[s])), s))[: SCALE - sum(ticks.values())]:
        ticks[s] += 1
    done, ran = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0)
    t = 0
    while any(done[s] < n for s, n in blocks.items() if s not in held):
        _, _, s = min((-(-(done[s] + 1) * SCALE // w), done[s] * SCALE // w, s) for s, w in ticks.items() if done[s] * SCALE // w <= t)
        ran[s] += min(block, max(0, sizes[s] - done[s] * block))
        done[s] += 1
        t += 1
    return ran, held


@pytest.mark.parametrize("sizes", [{"a": 1800, "b": 60, "c": 50, "d": 40, "e": 30, "": 20}, {"a": 400, "b": 240, "c": 200, "d": 100, "e": 60}, {"a": 900, "b": 60, "c": 40}, {"a": 900, "b": 90, "c": 80, "d": 70}, {"a": 30}])
def test_mixing_holds_large_sources(spark, sizes):
    from chronoforest.llm.mixing import mix_sources

    rows = [(i * 10 + j, s or None) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), max_share=0.25, block=4).collect()
    want, held = mixture(sizes, 0.25, 4)
    assert Counter(r["source"] for r in got if r["selected"]) == Counter(want) and len(got) == sum(sizes.values())
    assert all(want[s] == n for s, n in sizes.items() if s not in held) and len(held) < len(sizes)
    assert all(r["release"] <= r["slot"] < r["deadline"] if r["selected"] else r["slot"] is None for r in got)
    # ranks go by the md5 of the key
    for s in sizes:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in mine] == sorted((r["doc_id"] for r in mine), key=lambda k: __import__("hashlib").md5(str(k).encode()).hexdigest())


def test_mixing_sql_with_a_large_source(spark):
    import duckdb

    from chronoforest.llm.mixing import mix_sources
    from chronoforest.llm.queries import ORACLE_SQL

    for sizes in ({"a": 900, "b": 120, "c": 100, "d": 90, "e": 33, "f": 1}, {"a": 500, "b": 40}):
        rows = [(i * 10 + j, s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, source string")
        got = mix_sources(docs, max_share=0.25)
        c = duckdb.connect()
        c.register("documents", docs.toPandas())
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['op3_mix_sources']})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_katz_discounts_by_hand():
    from chronoforest.llm.katz import good_turing

    # counts of counts of the words of sf0.1's training folds: d4 of the plain formula is 1.22
    n = [0, 200420, 57120, 23804, 13644, 12859, 6775]
    d, form = good_turing(n)
    top = 40650 / 200420
    assert np.allclose(d[1:4], [73590 / 159770, (71412 / 114240 - top) / (1 - top), (54576 / 71412 - top) / (1 - top)]) and "smoothed from 4" in form
    b = np.polyfit(np.log(range(1, 7)), np.log(n[1:]), 1)[0] + 1
    assert np.allclose(d[4:], [(1.25**b - 6**b) / (1 - 6**b), (1.2**b - 6**b) / (1 - 6**b)])
    d, form = good_turing([0, 1000, 300, 140, 80, 50, 30])
    assert np.allclose(d[1:], [0.42 / 0.82, 0.52 / 0.82, (16 / 21 - 0.18) / 0.82, 0.60125 / 0.82, 0.54 / 0.82]) and form == "Good-Turing"
    # where 3 is missing the line goes through the rest; where nothing repeats there is no line
    d, form = good_turing([0, 1000, 100, 0, 10, 6, 3])
    assert "smoothed" in form and ((d[1:] > 0) & (d[1:] < 1)).all()
    d, form = good_turing([0, 9, 0, 0, 0, 0, 0])
    assert form == "absolute" and d[1] == 0.5


def test_katz_query_against_counts(spark, sf, texts):
    tok = {k: [*WORD.findall(t), "</s>"] for k, t in texts.items()}
    train = [k for k in tok if zlib.crc32(str(k).encode()) % 5 != 1]
    c1 = Counter(w for k in train for w in tok[k])
    c2 = Counter(p for k in train for p in zip(["<s>", *tok[k][:-1]], tok[k], strict=True))
    counts = lambda c: [0, *(sum(v == r for v in c.values()) for r in range(1, K + 2))]
    total, types = sum(c1.values()), len(c1)
    u, d = Unigrams(total, types, counts(c1)), discounts(counts(c2))
    p1 = dict(zip(c1, u.p(np.array(list(c1.values()))), strict=True))
    assert math.isclose(sum(p1.values()) + u.unknown, 1, abs_tol=1e-9)
    after = defaultdict(dict)
    for (a, b), c in c2.items():
        after[a][b] = c
    info = {}
    for a, f in after.items():
        n, freed = sum(f.values()), sum(c * (1 - d[c]) for c in f.values() if c <= K)
        shrink, left = (1.0, freed / n) if freed > 0 else (n / (n + 1), 1 / (n + 1))
        info[a] = (n, shrink, left / (1 - sum(p1[b] for b in f)))

    def p(b, a):
        if a not in after:
            return p1.get(b, u.unknown)
        n, shrink, alpha = info[a]
        return after[a][b] * (d[after[a][b]] if after[a][b] <= K else 1) / n * shrink if b in after[a] else alpha * p1.get(b, u.unknown)

    for a in [*list(after)[:20], "<s>", "never seen"]:
        assert math.isclose(sum(p(b, a) for b in c1) + p("unknown word", a), 1, abs_tol=1e-9)
    rows = QUERIES["op5_katz"](spark, sf).collect()
    assert len(rows) == len(tok)
    for r in rows:
        t = tok[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c1 for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((c1[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t), abs_tol=1e-6)
        assert math.isclose(r["score"], sum(math.log10(p(b, a)) for a, b in zip(["<s>", *t[:-1]], t, strict=True)), abs_tol=1e-6)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 9_000, "bucket_bytes": 4_000}])
def test_katz_order_three_against_counts(spark, sizes):
    """Trigrams by the recursion itself, over several blocks and buckets, normalised for every history."""
    from chronoforest.llm.katz import katz_scores

    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(vocab[int(j)] for j in np.minimum(rng.geometric(0.08, int(rng.integers(0, 60))), 60) - 1)) for i in range(400)]
    tok = {k: [*t.split(), "</s>"] for k, t in rows}
    train = [k for k in tok if zlib.crc32(str(k).encode()) % 5 != 1]
    grams = {1: Counter(w for k in train for w in tok[k])}
    for m in (2, 3):
        grams[m] = Counter(tuple((["<s>"] * (m - 1) + tok[k])[i : i + m]) for k in train for i in range(len(tok[k])))
    counts = lambda c: [0, *(sum(v == r for v in c.values()) for r in range(1, K + 2))]
    u = Unigrams(sum(grams[1].values()), len(grams[1]), counts(grams[1]))
    d = {m: discounts(counts(grams[m])) for m in (2, 3)}
    after = {m: defaultdict(dict) for m in (2, 3)}
    for m in (2, 3):
        for g, c in grams[m].items():
            after[m][g[:-1]][g[-1]] = c

    def p(history, w):
        if not history:
            return float(u.p(np.array([grams[1].get(w, 0)]))[0])
        m = len(history) + 1
        f = after[m].get(history)
        if f is None:
            return p(history[1:], w)
        n, freed = sum(f.values()), sum(c * (1 - d[m][c]) for c in f.values() if c <= K)
        shrink, left = (1.0, freed / n) if freed > 0 else (n / (n + 1), 1 / (n + 1))
        if w in f:
            return f[w] * (d[m][f[w]] if f[w] <= K else 1) / n * shrink
        return left / (1 - sum(p(history[1:], x) for x in f)) * p(history[1:], w)

    for h in [*list(after[3])[:10], ("<s>", "<s>"), ("v1", "never"), ("never", "v1")]:
        assert math.isclose(sum(p(h, w) for w in grams[1]) + p(h, "unknown word"), 1, abs_tol=1e-9)
    got = katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=3, **sizes).collect()
    assert len(got) == len(rows)
    for r in got:
        t = ["<s>", "<s>", *tok[r["doc_id"]]]
        assert math.isclose(r["score"], sum(math.log10(p((t[i], t[i + 1]), t[i + 2])) for i in range(len(t) - 2)), abs_tol=1e-6)


def linked_components(texts, k, percent):
    sets = {}
    for key, t in texts.items():
        w = WORD.findall(t)
        sets[key] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    low = {key: key for key in sets}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((top(a), top(b)))
                    low[y] = x
    return {key: (len(s), top(key)) for key, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_against_all_pairs(spark, sf, texts, k, percent):
    from chronoforest.llm.ngram_join import jaccard_components

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.read.parquet(f"{sf}/documents.parquet"), k=k, percent=percent).collect()}
    assert got == linked_components(texts, k, percent)


def test_ngram_chain(spark):
    """Links that no shard's smallest member has: a chain of texts, each near the next only."""
    from chronoforest.llm.ngram_join import jaccard_components

    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([f"n{j}" for j in range(i * 12)] + base[i * 12 :])) for i in range(12)]
    rows = [(k * 7 % 12, t) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == linked_components(dict(rows), 3, 90)


@pytest.mark.parametrize("shard", [4096, 9])
def test_ngram_shards_of_near_misses(spark, monkeypatch, shard):
    """Many texts just under the threshold with each other share their shards; a few are linked, and one group is large."""
    from chronoforest.llm import ngram_join as NJ

    monkeypatch.setattr(NJ, "SHARD", shard)
    rng = np.random.default_rng(3)
    n = 1000 if shard == 4096 else 120
    rows = []
    for i in range(n):
        words = [f"w{j}" for j in range(100)]
        cut = 3 if i % 5 == 0 else 97 - int(rng.integers(0, 8))
        words[cut] = "same" if i % 5 == 0 else f"own{i}"
        if i % 5 == 0:
            words[60 + i // 5 % 2 * 20] = f"own{i}"
        if i % 50 == 7:
            words[cut + 1 : cut + 3] = rows[-1][1].split()[cut + 1 : cut + 3]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in NJ.jaccard_components(docs, percent=95).collect()}
    assert got == linked_components(dict(rows), 3, 95)


def test_ngram_tiles_pair_up_all_but_the_largest_component(spark):
    from chronoforest.llm import ngram_join as NJ

    rows = [(5, d, 1 if d < 60 else d, 8, b"x") for d in range(80)] + [(6, d, d, 8, b"x") for d in range(3)]
    tiles = defaultdict(list)
    for r in NJ.dealt(spark.createDataFrame(rows, "key long, doc long, comp long, n long, point binary"), 7).collect():
        tiles[(r["key"], r["a"], r["b"])].append((r["doc"], r["comp"], r["side"]))
    met = Counter()
    for (key, _, _), t in tiles.items():
        met.update({(key, min(x[0], y[0]), max(x[0], y[0])): 1 for x in t for y in t if x[0] != y[0] and x[1] != y[1] and (x[2] is None or x[2] != y[2])})
    comp = {(k, d): c for k, d, c, _, _ in rows}
    want = {(k, a, b) for k, a in comp for j, b in comp if k == j and a < b and comp[(k, a)] != comp[(k, b)]}
    assert set(met) == want and set(met.values()) == {1} and max(map(len, tiles.values())) < 40


def test_ngram_key_with_a_twin_and_a_link(spark):
    """Key 5 repeats a text of key 3, and its other text links with key 9's."""
    from chronoforest.llm.ngram_join import jaccard_components

    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, [*b[:-1], "end"]), (12, c), (12, c), (14, c)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (12, 12), (12, 12), (14, 12)]


def test_classifiers_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    q = QUERIES["op4_quality"](spark, sf).join(lab, "doc_id").where("held_out")
    assert q.where("predicted = quality").count() >= 0.95 * q.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    held = QUERIES["op7_language"](spark, sf).join(docs, "doc_id").where("held_out AND n > 60")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()[want.columns]
    key = lambda d: sorted(map(str, d.itertuples(index=False, name=None)))
    assert key(got.astype(object).where(got.notna(), None)) == key(want.astype(object).where(want.notna(), None))


def test_warc_query(spark, sf):
    import base64
    import hashlib

    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {v: max(k for k in html if html[k] == v) for v in set(html.values())}
    for r in QUERIES["op9_warc"](spark, sf).collect():
        b = html[r["page_id"]]
        keep = last[b]
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if keep == r["page_id"] else "revisit", None if keep == r["page_id"] else keep)
        assert r["ok"] and (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want


def test_gumbel_statistics():
    v = S.Vocabulary(S.DEFAULT_MODEL, zipf=0.3)
    n = 20_000
    s = S.Sampler([b"the"] * n, mix(np.arange(n, dtype=np.uint64) + np.uint64(17)), v, 3)
    probs = {}
    for g in s.samples:
        assert len({tuple(p) for _, _, p in g}) == len(g) and all(a[0] >= b[0] for a, b in zip(g, g[1:], strict=False))
        for _, lp, path in g:
            probs[tuple(s.ids(path))] = math.exp(lp)
    assert math.isclose(sum(probs.values()), 1, abs_tol=1e-9)
    first, second = (Counter(tuple(s.ids(g[i][2])) for g in s.samples) for i in (0, 1))
    for k, p in probs.items():
        assert abs(first[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        q = sum(r * p / (1 - r) for j, r in probs.items() if j != k)
        assert abs(second[k] / n - q) < 5 * math.sqrt(q / n) + 1e-3


def test_segmentations_against_all_of_them(spark):
    """Each short text's segmentations, enumerated one by one: probabilities, ids, samples and thresholds."""
    v = S.Vocabulary(S.DEFAULT_MODEL)
    pieces = {}
    for i in range(len(v.bytes)):
        if v.find(np.array([S.hash_of(v.bytes[i])], np.uint64))[0] == i:
            pieces[v.bytes[i]] = i

    def ways(word):
        out = []

        def go(at, ids, logp):
            if at == len(word):
                out.append((tuple(ids), logp))
                return
            for end in range(at + 1, len(word) + 1):
                i = pieces.get(word[at:end])
                if i is not None:
                    go(end, [*ids, i], logp + v.log[i])
            w = 1 + (word[at] >= 0xC0) + (word[at] >= 0xE0) + (word[at] >= 0xF0)
            if word[at : at + w] not in pieces:
                spelt = [int(v.byte_id[b]) for b in word[at : at + w]]
                go(at + w, ids + spelt, logp + v.log[v.byte_id[0]] * w)

        go(0, [], 0.0)
        return out

    texts = ["an ox", "the", "a", "cat é", "of▁", "日 no", "  x", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    k = 5
    got = defaultdict(list)
    for r in S.sample_segmentations(docs, k=k).orderBy("sample").collect():
        got[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        raw = (" " + t).encode() if t else b""
        every = {(): 0.0}
        for word in re.findall(rb" [^ ]*", raw):
            every = {a + b: x + y for a, x in every.items() for b, y in ways(word)}
        z = np.logaddexp.reduce(list(every.values()))
        assert len(got[i]) == min(k, len(every)) and len({tuple(r["ids"]) for r in got[i]}) == len(got[i])
        for r in got[i]:
            assert math.isclose(r["log_prob"], every[tuple(r["ids"])] - z, abs_tol=1e-9) and r["exact"] and r["n_pieces"] == len(r["ids"])
        assert all(a["score"] >= b["score"] for a, b in zip(got[i], got[i][1:], strict=False))
        assert all(r["log_inclusion"] == 0 if len(every) <= k else r["log_inclusion"] <= 0 for r in got[i])
