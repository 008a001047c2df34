"""The corpus operators applied to the whole tables, with production parameters: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, collocations_sql, decision_list, html_tree, kneser_ney, licence_scan, merkle, merkle_sql, neighbour_quality, packing, pivotal, probminhash, quotes, spotsigs, zip_archive
from .shared import held_out, table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extracted(table(spark, sf_dir, "pages"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zip_archive.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_comparison(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbour_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_checksums(packing.packed(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = decision_list.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
    return rows.select("doc_id", *(F.col("verdict")[n].alias(n) for n in names))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kneser_ney.identified(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pivotal.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(F.col("mix")[n].alias(n) for n in ("size", "source_size", "target", "copies", "taken")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = merkle.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), claimed={"n_chars": F.col("n_chars") + tampered.cast("long")})
    rows = rows.withColumn("folded_root", merkle.folded(F.col("claimed"), F.col("path")))
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licence_scan.scanned(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_union(base, F.transform("spans", lambda s: s["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(every).alias("labels"), score.alias("score"), F.size("spans").alias("n_spans"),
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_warc_zip": op4_warc_zip,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_source_mixing": op10_source_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_licence_scan": op12_licence_scan,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: Classes of texts with plain Jaccard of 0.8 or more over five-word shingles, or probability Jaccard of their
#: counts, by brute force. The latter is at most the sum of the smaller shares, which rules most pairs out.
_OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') if x <> ''] AS w FROM documents),
s AS (SELECT doc_id, g, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [hash(w[i:i + 4]) for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [hash(w)] ELSE [] END) AS g FROM w) GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS n, sum(n) AS total, max(n) > 1 AS repeats FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, sum(least(a.n / x.total, b.n / y.total)) AS least_shares, any_value(x.n + y.n) AS n, any_value(x.repeats OR y.repeats) AS repeats FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN t x ON x.doc_id = a.doc_id JOIN t y ON y.doc_id = b.doc_id GROUP BY 1, 2),
plain AS (SELECT a, b FROM p WHERE 10 * c >= 8 * (n - c)),
may AS (SELECT a, b FROM p WHERE repeats AND 10 * c < 8 * (n - c) AND least_shares >= 0.8 - 1e-9),
u AS (SELECT a, b, g, sum(na) AS na, sum(nb) AS nb FROM (SELECT a, b, g, n AS na, 0 AS nb FROM may JOIN s ON doc_id = a UNION ALL SELECT a, b, g, 0, n FROM may JOIN s ON doc_id = b) GROUP BY 1, 2, 3),
z AS (SELECT d.a, d.b, d.g, sum(greatest(e.na / d.na, e.nb / d.nb)) AS z FROM u d JOIN u e ON d.a = e.a AND d.b = e.b WHERE d.na > 0 AND d.nb > 0 GROUP BY 1, 2, 3),
weighted AS (SELECT a, b FROM z GROUP BY 1, 2 HAVING sum(1 / z) >= 0.8 - 1e-12),
e AS (SELECT a, b FROM plain UNION SELECT a, b FROM weighted UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1
"""

#: Hexadecimal digits of the digest, five at a time, as four letters of base 32.
_OP4 = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) % 32 AS BIGINT), 1) for k in range(0, 32)], '') AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
"""

#: SQL for DuckDB where it can express a query.
ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dedup": _OP2, "op4_warc_zip": _OP4, "op11_merkle_manifest": merkle_sql.SQL, "op13_phrase_collocations": collocations_sql.SQL}
