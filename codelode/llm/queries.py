"""The queries of the training-data operators, by name: pN_... for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.tables import table

from . import abuse, corpus_bpe, docpairs, handwritten, leakage, splitting, syntax, vamana

Query = Callable[[SparkSession, str], DataFrame]


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(*(table(spark, d, t) for t in ("code_functions", "code_modules", "code_classes", "code_files", "file_contents")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("function_id")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return syntax.flag(table(spark, d, "code_files"), table(spark, d, "file_contents")).drop("why")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.flag(table(spark, d, "code_files"), table(spark, d, "file_contents")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.flag(table(spark, d, "code_files"), table(spark, d, "file_contents")).filter(F.col("why").isNotNull()).select("file_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "code_embeddings"), table(spark, d, "code_modules"), table(spark, d, "file_contents"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "code_embeddings"), table(spark, d, "code_modules"), table(spark, d, "file_contents"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vamana.nearest(table(spark, d, "code_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = vamana.nearest(table(spark, d, "code_embeddings"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "code_files"), table(spark, d, "file_contents"), table(spark, d, "repositories"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("file_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).groupBy("repository_id", "why").agg(F.count("*").alias("files"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_bpe.encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).filter(F.col("score") >= 0.5).select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_flags, p2_rates, p3_found, p3_pieces, p4_found, p4_neighbours, p5_found, p5_reasons, p6_ids, p7_found, p7_passages, p8_found, p8_scores, p8_rates)}

#: Only where SQL can say the same over whole tables.
ORACLE: dict[str, str] = {
    "p4_found": """
        WITH v AS (SELECT DISTINCT ON (id) id, entity_type, entity_id, embedding::DOUBLE[] AS e FROM code_embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.entity_type <> b.entity_type OR a.entity_id <> b.entity_id),
        r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 10
    """,
    "p3_found": """
        SELECT DISTINCT 'embedding' AS item_kind, id AS item_id FROM code_embeddings WHERE length(content) > 3000
        UNION ALL
        SELECT DISTINCT 'module', m.id FROM code_modules m JOIN file_contents c ON c.file_id = m.file_id
        WHERE length(array_to_string(string_split(c.content, chr(10))[greatest(coalesce(m.start_line, 1), 1) : least(coalesce(m.end_line, len(string_split(c.content, chr(10)))), len(string_split(c.content, chr(10))))], chr(10))) > 3000
    """,
}
