"""The queries that apply the operators of this package to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, extract, hardneg, langid, mixing, mtree, neardup, packing, pii, quality, substring, wand, warc
from tallyforge.llm.textcore import in_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(table(spark, sf_dir, "pages"), least_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", mtree.quantised(F.col("embedding")).alias("v"))
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spanned = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.counted(F.col("base_spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    base, every = pii.listed(F.col("base_spans")), pii.listed(F.concat("base_spans", "term_spans"))
    return spanned.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.removed_words(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    weights = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents.select("doc_id", "text"), weights).select(
        "doc_id",
        in_fold(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_pred").alias("predicted"),
    )


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_length(extract.extracted(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = langid.fit(documents)
    return langid.predict(documents.select("doc_id", "text"), profiles).select(
        "doc_id",
        in_fold(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearParams(shingle=3, percent=85))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.vectors(table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hardneg.mined(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_pack": op3_pack,
    "op4_topk": op4_topk,
    "op5_pii": op5_pii,
    "op6_substring": op6_substring,
    "op7_quality": op7_quality,
    "op8_extract": op8_extract,
    "op9_langid": op9_langid,
    "op10_near": op10_near,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_wand": op12_wand,
    "op13_mix": op13_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (
            SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
                   list_transform(range(0, 8), lambda g: ('0x' || substr(sha1(h), g::INTEGER * 5 + 1, 5))::BIGINT) AS groups
            FROM p
        ), b AS (
            SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(groups, lambda v: list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)))), '') AS payload_digest
            FROM d
        ), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM m
    """,
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_substring": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, s, array_to_string(ws[s : s + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(s)),
        f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
        c AS (SELECT DISTINCT doc_id, s + o AS i FROM g JOIN f USING (k), unnest(range(0, 13)) AS t(o) WHERE m < doc_id),
        x AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
        k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id
    """,
    "op10_near": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
            FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(ws[s : s + 2], ' ') AS k
            FROM w, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS t(s)
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * n_both >= 85 * (nx.n + ny.n - n_both)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
            WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
        ), n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
    "op12_wand": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
            FROM documents WHERE text IS NOT NULL
        ), e AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
        t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM e),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM benchmark WHERE text IS NOT NULL
        ), p AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM e) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3
        ), w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term, docs),
        i AS (SELECT doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS impact FROM p JOIN w ON w.term = p.term, t),
        s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i ON i.term = q.term GROUP BY 1, 2),
        r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
    """,
    "op13_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(concat_ws(chr(31), doc_id::VARCHAR, text)), 1, 6))::BIGINT % 64 AS salt FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY 1
        ), f AS (
            SELECT *, 3.0::DOUBLE * source_size AS most, coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
                   sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)
        ), g AS (SELECT *, max((SELECT (sum(source_size) - full_) / open_ FROM s)) OVER () AS level FROM f),
        t AS (
            SELECT source, source_size, n_docs, least(most, weight * level) AS target,
                   CASE WHEN source_size > 0 THEN floor(least(most, weight * level) / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS rate,
                   ('0x' || substr(md5(concat_ws(chr(31), 'mix', coalesce('0' || source, '1'))), 7, 6))::BIGINT AS start FROM g
        ), c AS (SELECT *, length(bin(size)) * 32 + CASE WHEN length(bin(size)) > 5 THEN size >> (length(bin(size)) - 5) ELSE size END AS step FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY step, salt, size, doc_id NULLS FIRST) AS rank FROM c),
        p AS (
            SELECT r.doc_id, r.size, t.source_size, t.target, r.source, rate, start, CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n_docs + 1 - rank // 2 END AS place
            FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
        ), k AS (SELECT *, (place * rate + start) // 16777216 - ((place - 1) * rate + start) // 16777216 AS copies FROM p)
        SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM k
    """,
}
