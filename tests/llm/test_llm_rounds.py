import random


def test_ngram_members_with_points_fit_the_text(spark, monkeypatch):
    """Texts that share much, but link with few, meet in most shards: their rows with points come in rounds."""
    from chronoforest.llm import ngram_join as NJ

    rng = random.Random(3)
    common = [f"c{i}" for i in range(32)]
    rows = [(i, " ".join([*common, *(f"w{rng.randrange(10**6)}" for _ in range(8))])) for i in range(300)]
    rows += [(300 + i, rows[i][1].rsplit(" ", 1)[0] + " other") for i in range(5)]
    sizes, plain = [], NJ.unresolved_pairs

    def counted(members, *more):
        sizes.append(members.count())
        return plain(members, *more)

    monkeypatch.setattr(NJ, "unresolved_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in NJ.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()}
    assert got == {i: i % 300 for i, _ in rows}
    bytes_of_texts = sum(len(t) for _, t in rows)
    assert len(sizes) > 3 and 160 * max(sizes) < 2.5 * bytes_of_texts, (sizes, bytes_of_texts)


def test_lattice_takes_new_words_in_parts(monkeypatch):
    """Arcs of many new words are built in parts: what that takes for a while stays under what is kept, and no arc changes."""
    import tracemalloc

    import numpy as np

    from chronoforest.llm import sentencepiece_lattice as S

    rng = np.random.default_rng(5)
    v = S.Vocabulary(S.DEFAULT_MODEL)
    raw = np.frombuffer(b"".join(b" " + bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(1, 12, 50_000)), np.uint8)
    at = np.flatnonzero(raw == 32)
    length = np.diff(np.append(at, len(raw)))
    S.Lattice(v).begins(raw, at, length)  # tables of powers
    lat = S.Lattice(v)
    tracemalloc.start()
    begin = lat.begins(raw, at, length)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert lat.n_bytes > 200_000
    assert most < 140 * lat.n_bytes, (kept / lat.n_bytes, most / lat.n_bytes)
    monkeypatch.setattr(S, "ADDED_BYTES", 1 << 30, raising=False)
    one = S.Lattice(v)
    assert (one.begins(raw, at, length) == begin).all()
    for name in ("pos", "size", "piece", "last", "logp", "upto"):
        assert (getattr(one, name)[: one.n_arcs] == getattr(lat, name)[: lat.n_arcs]).all(), name


def test_quality_learns_from_every_labelled_row_and_pair(spark):
    """A kind of text whose labels come after the first 2,000 of its class counts; partitions don't; the fit is one of all pairs."""
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa

    from chronoforest.llm import quality as Q
    from chronoforest.llm.textcore import column_bytes

    keys = sorted((k for k in range(3500) if zlib.crc32(str(k).encode()) % 5), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    plain, loud, figures = "the quiet river ran past the old town and its mill {}", "BUY NOW!!! $$$ {} CLICK >>> HERE ###", "the quiet river ran 73 91 past 5 of 20 old {} 4 towns 18"
    late = keys[2100:]
    rows = [(k, loud.format(k % 50), 0) for k in keys[:2100]] + [(k, figures.format(k % 50), 0) for k in late]
    rows += [(10_000 + i, plain.format(i % 50), 1) for i in range(500)]
    rows += [(20_000 + i, figures.format(60 + i), None) for i in range(20)] + [(30_000 + i, plain.format(60 + i), None) for i in range(20)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([r[::2] for r in rows if r[2] is not None], "doc_id long, quality int")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in Q.quality_scores(docs.repartition(3), labels).collect()}
    assert all(got[20_000 + i][1] == 0 and got[30_000 + i][1] == 1 for i in range(20))
    assert got == {r["doc_id"]: (r["score"], r["predicted"]) for r in Q.quality_scores(docs.repartition(7, "text"), labels.repartition(5)).collect()}

    part = [r for r in rows if r[2] is not None][::23]
    x = Q.features(*column_bytes(pa.array([r[1] for r in part])))
    y = np.array([r[2] for r in part])
    table = spark.createDataFrame([(int(c), v.tobytes()) for c, v in zip(y, x, strict=True)], "y int, x binary")
    weight = np.random.default_rng(1).normal(0, 0.05, Q.WIDTH)
    model = Q.PairwiseRanker(x[y == 1, : Q.WIDTH].mean(0), x[:, : Q.WIDTH].std(0) + 1e-4, weight, 0.0, 1.0, 0.3)
    now, z = Q.PairLoss(table, model, weight), model.standard(x).astype(np.float64)
    lead = (z @ weight)[y == 0][None, :] - (z @ weight)[y == 1][:, None]
    p = 1 / (1 + np.exp(-lead))
    assert np.isclose(now.loss, np.logaddexp(0, lead).mean(), atol=1e-3)
    assert np.allclose(now.gradient(table), p.mean(0) @ z[y == 0] / (y == 0).sum() - p.mean(1) @ z[y == 1] / (y == 1).sum(), atol=2e-3)


def test_ngram_near_misses_leave_no_pairs(spark, monkeypatch):
    """Texts that meet in most shards and miss the threshold by little: no row for each pair and shard leaves the joins."""
    from chronoforest.llm import ngram_join as NJ

    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(395), 14):
            words[at] = f"own{i}.{at}"
        rows.append((i, " ".join(words)))
    rows += [(90 + i, rows[i][1].rsplit(" ", 1)[0] + " other") for i in range(5)]
    made, plain = [], NJ.unresolved_pairs

    def counted(*args):
        links = plain(*args)
        made.append(links.count())
        return links

    monkeypatch.setattr(NJ, "unresolved_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i % 90 for i, _ in rows}
    assert {r["doc_id"]: r["component_id"] for r in NJ.jaccard_components(docs, k=5, percent=80).collect()} == want
    assert sum(made) < len(rows), made
    # as if the family were too large for whole tiles: its shards, one by one
    monkeypatch.setattr(NJ, "FAMILY", 0)
    assert {r["doc_id"]: r["component_id"] for r in NJ.jaccard_components(docs, k=5, percent=80).collect()} == want


def test_components_take_few_tables(spark, monkeypatch):
    """Each table of a step costs the driver jobs, exchanges and broadcasts: edges that fit a task are done in one step."""
    from chronoforest.llm import components as C

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(-5, 7), (7, -5), (9, 9)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        before = dict(least)
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
        if least == before:
            break
    want = {x: c for x, c in least.items() if x != c}
    tables, plain = [], C.stored

    def counted(*args):
        tables.append(args[1])
        return plain(*args)

    monkeypatch.setattr(C, "stored", counted)
    table = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = C.components(table).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert len(tables) <= 2, tables
    # more edges than a task joins
    monkeypatch.setattr(C, "PART", 20, raising=False)
    got = C.components(table).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert C.components(table.where("u > 5000")).count() == 0


def test_lattice_looks_up_what_pieces_begin_with(monkeypatch):
    """Substrings that no longer piece begins with are not lengthened; the arcs are all pieces that occur, and words forgotten come back."""
    import numpy as np

    from chronoforest.llm import sentencepiece_lattice as S

    rng = np.random.default_rng(7)
    v, asked, plain = S.Vocabulary(S.DEFAULT_MODEL), [], S.mix
    monkeypatch.setattr(S, "mix", lambda h: (asked.append(len(h)), plain(h))[1])
    words = [b" " + bytes(rng.integers(97, 123, 24).astype(np.uint8)) for _ in range(300)] + [" internationalisation".encode(), " größer".encode(), " 漢字▁ก".encode(), b" "]
    raw = np.frombuffer(b"".join(words), np.uint8)
    at = np.flatnonzero(raw == 32)
    length = np.diff(np.append(at, len(raw)))
    lat = S.Lattice(v)
    begin = lat.begins(raw, at, length)
    assert sum(asked) < 2 * len(raw), sum(asked) / len(raw)
    piece_of = {v.bytes[i]: int(i) for i in v.ids}
    for w, b in zip(words, begin, strict=True):
        for i in range(len(w)):
            arcs = range(lat.first[b + i], lat.first[b + i + 1])
            want = {(j - i, piece_of[w[i:j]]) for j in range(i + 1, len(w) + 1) if w[i:j] in piece_of} if w[i] & 0xC0 != 0x80 else set()
            assert {(int(lat.size[a]), int(lat.piece[a])) for a in arcs if lat.piece[a] >= 0} == want
    arcs = {name: getattr(lat, name)[: lat.n_arcs].copy() for name in ("pos", "size", "piece", "last", "next", "logp", "upto")}
    lat.clear()
    assert (lat.begins(raw, at, length) == begin).all()
    assert all((getattr(lat, name)[: lat.n_arcs] == x).all() for name, x in arcs.items())
