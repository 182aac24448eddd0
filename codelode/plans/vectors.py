"""Vector search over stored and given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import vectors as vx

from .base import Data, query

COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query(f"SELECT b.vec_id, b.label, {COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY similarity DESC, b.vec_id LIMIT 10")
def vec2_similar(d: Data):
    return vx.similar_to(d.embeddings, 0).select("vec_id", "label", "similarity")


@query(f"SELECT b.vec_id, {COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 AND b.label IN (1, 2, 3) AND {COS} >= 0.1 ORDER BY similarity DESC, b.vec_id LIMIT 20")
def vec1_scoped_threshold(d: Data):
    return vx.similar_to(d.embeddings, 0, 20, 0.1, lambda _: F.col("label").isin(1, 2, 3)).select("vec_id", "similarity")


@query(f"SELECT b.vec_id, {COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 AND a.label <> b.label ORDER BY similarity DESC, b.vec_id LIMIT 10")
def vec2_exclude_same_file(d: Data):
    return vx.similar_to(d.embeddings, 3, 10, None, lambda r: F.col("label") != r["label"]).select("vec_id", "similarity")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.1::DOUBLE)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")
def vec4_given_vector(d: Data):
    return vx.search(d.embeddings, [0.1] * 64).select("vec_id", "similarity")


@query(f"SELECT b.vec_id, {COS} AS similarity, round({COS} * CASE WHEN b.label = 5 THEN 1.2 ELSE 1.0 END, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY score DESC, b.vec_id LIMIT 10")
def vec10_boosted(d: Data):
    got = vx.similar_to(d.embeddings, 0, 2**31 - 1)
    return got.withColumn("score", F.round(F.col("similarity") * F.when(F.col("label") == 5, 1.2).otherwise(1.0), 6)).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "similarity", "score")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.4")
def vec8_pairs_above(d: Data):
    return vx.pairs_above(d.embeddings, 0.4)


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def vec8_exact_duplicates(d: Data):
    return d.documents.filter("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("SELECT label, (i - 1)::INTEGER AS position, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY label, i")
def vec_centroids(d: Data):
    return vx.centroids(d.embeddings, "label").select("label", "position", F.round("mean", 6).alias("mean"))


@query(f"WITH w AS (SELECT a.vec_id AS a, b.vec_id AS b, 1.0::DOUBLE AS weight, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, b, round(weight * (0.5 + 0.5 * c), 6) AS weight FROM w")
def vec15_edge_reweight(d: Data):
    e = d.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    f = d.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(f, "a").select("a", "b", F.round(0.5 + 0.5 * vx.cosine("x", "y"), 6).alias("weight"))


@query()
def vec16_missing_embeddings(d: Data):
    fns = d.where("functions", "docstring is not null").select(F.col("docstring").alias("text"))
    cache = vx.embed_missing(d.where("classes", "docstring is not null").select(F.col("docstring").alias("text")), d.spark.createDataFrame([], "digest string"))
    return vx.embed_missing(fns, cache)


@query("SELECT id AS entity_id, 'raw' AS embedding_type, concat('Function ', name, chr(10), coalesce(docstring, '')) AS text FROM functions UNION ALL SELECT id, 'interpreted', concat('Function ', name, ' that takes ', len(coalesce(parameters, [])), ' parameters') FROM functions", "functions")
def vec18_dual_texts(d: Data):
    raw = d.functions.select(F.col("id").alias("entity_id"), F.lit("raw").alias("embedding_type"), F.concat(F.lit("Function "), "name", F.lit("\n"), F.coalesce("docstring", F.lit(""))).alias("text"))
    n = F.coalesce(F.size("parameters"), F.lit(0)).cast("string")
    return raw.unionByName(d.functions.select(F.col("id").alias("entity_id"), F.lit("interpreted").alias("embedding_type"), F.concat(F.lit("Function "), "name", F.lit(" that takes "), n, F.lit(" parameters")).alias("text")))


@query()
def vec20_ivf_search(d: Data):
    from codelode.operators.ivf import ivf_search

    return ivf_search(d.embeddings, "vec_id", k=10)
