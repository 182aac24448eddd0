"""Vector search: cosine in the JVM for one query vector, Arrow blocks for all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    """In double, in order, so both sides of a comparison add up alike."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """dot / (|a| |b|); null for a zero vector or unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0))))


def similar_to(df: DataFrame, vec_id: int, limit: int = 10, threshold: float | None = None, but: Callable[[Row], Column] | None = None, key: str = "vec_id") -> DataFrame:
    """The nearest of a stored vector, itself excluded. The one row is looked up and becomes a literal; the rest is a scan and a top-k.

    ``but`` makes a further filter of that row. An unknown id is an error, raised when the plan is built.
    """
    row = df.filter(F.col(key) == vec_id).first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    got = df.filter(F.col(key) != vec_id)
    if but is not None:
        got = got.filter(but(row))
    return search(got, row["embedding"], limit, threshold, key)


def search(df: DataFrame, vector: list[float], limit: int = 10, threshold: float | None = None, key: str = "vec_id") -> DataFrame:
    """The nearest of a given vector."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    got = df.withColumn("similarity", F.round(cosine("embedding", q), 6))
    if threshold is not None:
        got = got.filter(F.col("similarity") >= threshold)
    return got.filter("similarity is not null").orderBy(F.desc("similarity"), key).limit(limit)


def pairs_above(df: DataFrame, threshold: float, key: str = "vec_id", block: int = 2048) -> DataFrame:
    """(a, b, similarity) of all pairs at or above the threshold, a < b, exactly.

    Rows go to blocks of bounded size by hash; each pair of blocks is one matrix product in a task of its own.
    """
    n = df.count()
    blocks = max(1, -(-n // block))
    b = df.select(F.col(key).alias("id"), "embedding", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("blk"))
    left = b.select("id", "embedding", F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("j"))
    right = b.select(F.col("id").alias("other"), F.col("embedding").alias("vector"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        u, v = np.stack(x.embedding).astype(float), np.stack(y.vector).astype(float)
        un, vn = np.linalg.norm(u, axis=1, keepdims=True), np.linalg.norm(v, axis=1, keepdims=True)
        s = np.round((u / np.where(un == 0, np.nan, un)) @ (v / np.where(vn == 0, np.nan, vn)).T, 6)
        same = x.i.iloc[0] == x.j.iloc[0]
        r, c = np.nonzero(s >= threshold)
        a, d = x.id.to_numpy()[r], y.other.to_numpy()[c]
        keep = a < d if same else a != d
        a, d, t = a[keep], d[keep], s[r, c][keep]
        return pd.DataFrame({"a": np.minimum(a, d), "b": np.maximum(a, d), "similarity": t})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(product, "a long, b long, similarity double")


def hash_embedder(dim: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A deterministic bag-of-words embedder for tests and for when no model is given: (id, text) -> (id, embedding)."""
    import xxhash

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                v = np.zeros(dim, np.float32)
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dim] += 1 if h >> 63 else -1
                out.append(v.tolist() if t else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["id", "embedding"])

    return embed


def embed_texts(df: DataFrame, key: str, text: str, embedder=None) -> DataFrame:
    """(key, embedding) by a pluggable embedder over Arrow batches; a null text has a null vector."""
    src = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(embedder or hash_embedder(), "id long, embedding array<float>").withColumnRenamed("id", key)


def embed_missing(df: DataFrame, cache: DataFrame, text: str = "text", embedder=None) -> DataFrame:
    """(digest, embedding) of the texts the cache (digest, embedding) lacks; equal texts are embedded once."""
    t = df.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")
    n = t.withColumn("id", F.monotonically_increasing_id())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = embedder or hash_embedder()
        for b in batches:
            for got in run(iter([pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["id", "text"])])):
                yield pa.RecordBatch.from_arrays([b.column(2), got.column(1)], ["digest", "embedding"])

    return n.select("id", "text", "digest").mapInArrow(keyed, "digest string, embedding array<float>")


def centroids(df: DataFrame, by: str) -> DataFrame:
    """(by, position, mean): the mean vector of each group, position by position, with map-side combining."""
    return df.select(by, F.posexplode("embedding").alias("position", "x")).groupBy(by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def similar_patterns(patterns: DataFrame, pattern_type: str, confidence: float = 0.8) -> DataFrame:
    """Of what an analyzer found, the rows of a type that it is confident of, the surest first."""
    return patterns.filter((F.col("pattern_type") == pattern_type) & (F.col("confidence") >= confidence)).orderBy(F.desc("confidence"), *[c for c in patterns.columns if c not in ("pattern_type", "confidence")])


def similarity_metrics(pairs: DataFrame) -> DataFrame:
    """(pairs, mean, highest) of the similarities of pairs."""
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg("similarity"), 4).alias("mean"), F.max("similarity").alias("highest"))
