"""The thin queries of this subpackage: production parameters over whole tables, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jpeg import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), max_share=0.25)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).drop("text")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_records

    out = warc_records(table(spark, sf_dir, "pages"))
    return out.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "ok")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations a document without replacement, with their piece ids."""
    from .sentencepiece_lattice import sample_segmentations

    return sample_segmentations(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair

    return repair(table(spark, sf_dir, "conversations"), damage=damaged)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tampered, verify

    docs = table(spark, sf_dir, "documents")
    return verify(docs, changed=tampered(docs))


def op13_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset_hash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jpeg": op1_jpeg,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality": op4_quality,
    "op5_katz": op5_katz,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_conversations": op11_conversations,
    "op12_merkle": op12_merkle,
    "op13_multiset_hash": op13_multiset_hash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": """
        WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS rank, greatest(16, (count(*) OVER () + 16383) // 16384) AS size FROM docs),
        sizes AS (SELECT source, (count(*) + any_value(size) - 1) // any_value(size) AS n, count(*) OVER () AS k, greatest(0.25::DOUBLE, 1::DOUBLE / count(*) OVER ()) AS cap FROM ranked GROUP BY source),
        falling AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) - 1 AS place, sum(n) OVER (ORDER BY n DESC, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM sizes),
        water AS (SELECT *, coalesce(min(place) FILTER (n * (1 - place * cap) <= cap * rest) OVER (), k - 1) AS j FROM falling),
        weight AS (SELECT source, n, k, place < j AS capped, CASE WHEN place < j THEN cap ELSE n::DOUBLE / (max(rest) FILTER (place >= j) OVER ())::DOUBLE * (1 - j * cap) END * (1099511627776 - k) AS x FROM water),
        ticks AS (SELECT source, n, capped, (1 + floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, source) <= 1099511627776 - k - sum(floor(x)) OVER ())::INT)::BIGINT AS ticks FROM weight),
        run(t, s, source, block) AS (
            SELECT -1::BIGINT, list({source: source, ticks: ticks, done: 0::BIGINT} ORDER BY source), NULL::VARCHAR, NULL::BIGINT FROM ticks
            UNION ALL
            SELECT t + 1, list_transform(s, lambda x: {source: x.source, ticks: x.ticks, done: x.done + (x.source = p.source)::BIGINT}), p.source, p.done FROM (
                SELECT t, s, list_sort(list_transform(list_filter(s, lambda x: x.done * 1099511627776 // x.ticks <= t + 1),
                    lambda x: {deadline: ((x.done + 1) * 1099511627776 + x.ticks - 1) // x.ticks, release: x.done * 1099511627776 // x.ticks, source: x.source, done: x.done}))[1] AS p
                FROM run WHERE len(s) > 0 AND t + 1 < (SELECT max((n * 1099511627776 + ticks - 1) // ticks) FROM ticks WHERE NOT capped))),
        plan AS (SELECT run.source, block, t AS slot, block * 1099511627776 // ticks AS release, ((block + 1) * 1099511627776 + ticks - 1) // ticks AS deadline FROM run JOIN ticks USING (source)
            WHERE t <= (SELECT max(r.t) FROM run r JOIN ticks k ON k.source = r.source AND r.block = k.n - 1 WHERE NOT k.capped))
        SELECT doc_id, ranked.source, rank, rank // size AS block, slot, release, deadline, slot IS NOT NULL AS selected FROM ranked LEFT JOIN plan ON plan.source = ranked.source AND plan.block = rank // size""",
    "op9_warc": """
        SELECT page_id, strlen(p) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha1(p), 1 + (i // 4 * 5)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) % 32, 1)), '') AS payload_digest,
            CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to, true AS ok
        FROM (SELECT page_id, coalesce(html, '') AS p FROM pages) WINDOW g AS (PARTITION BY p)""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_conversations": r"""
        WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
        placed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS p FROM conversations),
        kinds AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(p) + 1), lambda i: ascii(substr(p, i, 1))::BIGINT)),
            lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) % 20 AS k FROM placed, crc_table),
        damaged AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM damaged),
        ordered AS (SELECT *, left(role, 1) AS r,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), again) AS i FROM seen),
        faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '' ELSE 't' END AS f,
            lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM ordered),
        counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
            count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
        -- cost and audit of the rows from i on, by grammar state: nothing yet, after s, after u, after a
        best AS (SELECT conv_id, n + 1 AS i, {c: 0::BIGINT, a: ''} AS o, {c: 4::BIGINT, a: 'II'} AS s, {c: 2::BIGINT, a: 'I'} AS u, {c: 0::BIGINT, a: ''} AS a FROM counts
            UNION ALL SELECT conv_id, i,
                list_min([o, {c: u.c + 2, a: 'I' || u.a}, {c: a.c + 4, a: 'II' || a.a}]), list_min([s, {c: u.c + 2, a: 'I' || u.a}, {c: a.c + 4, a: 'II' || a.a}]),
                list_min([u, {c: a.c + 2, a: 'I' || a.a}]), list_min([a, {c: u.c + 2, a: 'I' || u.a}])
            FROM (SELECT b.conv_id, x.i,
                list_min(list_filter([{c: o.c + 3, a: 'D' || o.a}, {c: u.c + 2 + e, a: 'R' || u.a}, {c: u.c + e + CASE r WHEN 'u' THEN 0 ELSE 1000000 END, a: 'K' || u.a}, {c: s.c + e + CASE r WHEN 's' THEN 0 ELSE 1000000 END, a: 'K' || s.a}], lambda q: q.c < 1000000)) AS o,
                list_min(list_filter([{c: s.c + 3, a: 'D' || s.a}, {c: u.c + 2 + e, a: 'R' || u.a}, {c: u.c + e + CASE r WHEN 'u' THEN 0 ELSE 1000000 END, a: 'K' || u.a}], lambda q: q.c < 1000000)) AS s,
                list_min(list_filter([{c: u.c + 3, a: 'D' || u.a}, {c: a.c + 2 + e, a: 'R' || a.a}, {c: a.c + e + CASE r WHEN 'a' THEN 0 ELSE 1000000 END, a: 'K' || a.a}], lambda q: q.c < 1000000)) AS u,
                list_min(list_filter([{c: a.c + 3, a: 'D' || a.a}, {c: u.c + 2 + e, a: 'R' || u.a}, {c: u.c + e + CASE r WHEN 'u' THEN 0 ELSE 1000000 END, a: 'K' || u.a}], lambda q: q.c < 1000000)) AS a
                FROM best b JOIN (SELECT conv_id, i, r, CASE f WHEN '' THEN 0 WHEN 't' THEN 1 ELSE 1000000 END AS e FROM faults) x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i - 1)),
        audits AS (SELECT conv_id, o.c AS cost, o.a AS audit FROM best WHERE i = 1),
        edits AS (SELECT conv_id, step, edit, step - count(*) FILTER (edit = 'I') OVER w AS i, step - count(*) FILTER (edit = 'D') OVER w AS place
            FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS step, unnest(string_split(audit, '')) AS edit FROM audits WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
        left_over AS (SELECT e.conv_id, step, place, edit, x.role, CASE edit WHEN 'I' THEN '' ELSE x.text END AS text,
            max((edit = 'K' AND x.r = 's')::INT) OVER (PARTITION BY e.conv_id) AS s
            FROM edits e LEFT JOIN faults x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.i = e.i AND edit <> 'I' WHERE edit <> 'D'),
        repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY step)) AS h FROM left_over GROUP BY conv_id)
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
            LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op12_merkle": """
        WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
        docs AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
            lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) % 5 = 0 AND doc_id IS NOT NULL AS hit FROM documents, crc_table),
        hashed AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed
            FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs)),
        leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
            count(*) OVER (PARTITION BY source) AS n FROM hashed),
        low AS (SELECT 0 AS h, tree, rank AS i, n, leaf AS d FROM leaves
            UNION ALL SELECT h + 1, tree, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY ALL),
        subroots AS (SELECT tree, d, count(*) OVER () AS k FROM low WHERE n = 1),
        high AS (SELECT 0 AS h, -1 AS tree, tree AS i, k AS n, d FROM subroots
            UNION ALL SELECT h + 1, tree, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY ALL),
        sides AS (SELECT h, tree, i, coalesce(string_agg(d, '') OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(d, '') OVER (g ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM (FROM low UNION ALL FROM high) WHERE n > 1 WINDOW g AS (PARTITION BY h, tree, i // 16 ORDER BY i)),
        steps AS (SELECT doc_id, leaf, leaves.tree, rank, h, l, r FROM leaves JOIN sides ON sides.tree = leaves.tree AND i = rank // (16 ** h)::BIGINT
            UNION ALL SELECT doc_id, leaf, leaves.tree, rank, 100 + h, l, r FROM leaves JOIN sides ON sides.tree = -1 AND i = leaves.tree // (16 ** h)::BIGINT),
        paths AS (SELECT tree, rank, string_agg(l || r, '' ORDER BY h) AS p, list({l: l, r: r} ORDER BY h) AS s FROM steps GROUP BY ALL),
        ends AS (SELECT leaves.doc_id, leaf, subroots.d AS subroot, (SELECT d FROM high WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256,
            list_reduce(list_concat([{l: changed, r: ''}], coalesce(s, [])), lambda a, x: {l: sha256(x.l || a.l || x.r), r: ''}).l AS folded_root
            FROM leaves JOIN subroots USING (tree) LEFT JOIN paths USING (tree, rank))
        SELECT *, folded_root = root AS verified FROM ends""",
}
