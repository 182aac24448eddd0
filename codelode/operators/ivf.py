"""Inverted-file search: k-means cells, each query looks into its nearest cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ivf_search(df: DataFrame, key: str, k: int = 10, lists: int | None = None, probes: int | None = None, recall: float = 0.95, sample: int = 20_000, every: int = 20, cell_rows: int = 4096) -> DataFrame:
    """(id, neighbour, similarity): for every id divisible by ``every`` its k nearest of all rows.

    There are about as many cells as the root of the rows, unless ``lists`` says otherwise, so a query's share of the rows
    shrinks as they grow. Unless ``probes`` says otherwise, so many cells are read that ``recall`` of the true neighbours
    of a part of the sample, found exactly, lie in them. Cells are fitted on at most ``sample`` rows by hash order; every row is indexed. Large cells are split into slices of
    about ``cell_rows`` rows, each searched in a task of its own, and the slices' best are merged.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    fit = rows.orderBy(F.xxhash64("id")).limit(sample).select("embedding").toPandas()
    if not len(fit):
        return spark.createDataFrame([], "id long, neighbour long, similarity double")
    x = np.stack(fit.embedding).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lists = min(lists or max(16, int(rows.count() ** 0.5)), max(1, len(x) // 4))
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(15):
        at = np.argmax(x @ c.T, axis=1)
        for j in range(lists):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    centres = spark.sparkContext.broadcast(c)
    if probes is None:
        q = x[:: max(1, len(x) // 512)]
        near = q @ x.T
        near[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // 512))] = -2
        m = min(k, max(1, len(x) - 1))
        cell = np.argmax(x @ c.T, axis=1)[np.argpartition(-near, m - 1, axis=1)[:, :m]]
        rank = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
        probes = int(np.ceil(np.quantile(np.take_along_axis(rank, cell, axis=1), recall))) + 1
    n = min(probes, lists)

    def cells(frames, count):
        for pdf in frames:
            if len(pdf):
                v = np.stack(pdf.embedding).astype(np.float32)
                near = np.argsort(-(v @ centres.value.T), axis=1)[:, :count]
                yield pdf.assign(cells=list(near))

    schema = "id long, embedding array<float>, cells array<int>"
    index = rows.mapInPandas(lambda it: cells(it, 1), schema).select("id", "embedding", F.col("cells")[0].alias("cell"))
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("slices"))
    index = index.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    ask = rows.filter(F.col("id") % every == 0).mapInPandas(lambda it: cells(it, n), schema).select("id", "embedding", F.explode("cells").alias("cell"))
    ask = ask.join(F.broadcast(sizes), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        p, q = np.stack(a.embedding).astype(float), np.stack(b.vector).astype(float)
        s = (p / np.linalg.norm(p, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
        s[a.id.to_numpy()[:, None] == b.other.to_numpy()] = -2
        m = min(k, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"id": np.repeat(a.id.to_numpy(), m), "neighbour": b.other.to_numpy()[top].ravel(), "similarity": np.round(np.take_along_axis(s, top, axis=1), 6).ravel()})

    found = ask.select("cell", "slice", "id", "embedding").groupBy("cell", "slice").cogroup(index.select("cell", "slice", F.col("id").alias("other"), F.col("embedding").alias("vector")).groupBy("cell", "slice")).applyInPandas(look, "id long, neighbour long, similarity double").filter("similarity > -2")
    from pyspark.sql.window import Window

    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
