"""Chunks of source files: by entity, by lines, the prolog, by characters on line boundaries, merged small ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_lines(contents: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """(file_id, chunk, start_line, end_line, has_overlap, code): windows of ``size`` lines, each starting ``size - overlap`` after the one before."""
    stride = size - overlap
    c = contents.filter(F.col("content").isNotNull()).select("file_id", F.split("content", "\n").alias("lines")).withColumn("n", F.size("lines"))
    e = c.select("file_id", "lines", "n", F.posexplode(F.sequence(F.lit(1), F.col("n"), F.lit(stride))).alias("chunk", "start_line"))
    return e.select("file_id", "chunk", "start_line", F.least(F.col("start_line") + size - 1, "n").alias("end_line"), (F.col("chunk") > 0).alias("has_overlap"), F.array_join(F.slice("lines", F.col("start_line"), F.lit(size)), "\n").alias("code"))


def by_entity(functions: DataFrame, classes: DataFrame, modules: DataFrame, contents: DataFrame, large: int = 100, before: int = 3, after: int = 2) -> DataFrame:
    """(file_id, kind, id, name, start_line, end_line): functions, classes, and the methods of classes longer than ``large`` lines, with context lines."""
    m = modules.select(F.col("id").alias("module_id"), "file_id")
    n = contents.filter(F.col("content").isNotNull()).select("file_id", F.size(F.split("content", "\n")).alias("n"))
    cls = classes.filter("start_line is not null and end_line is not null")
    big = cls.filter(F.col("end_line") - F.col("start_line") + 1 > large).select(F.col("id").alias("class_id"))
    fn = functions.filter("start_line is not null and end_line is not null")
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "name", "module_id", "start_line", "end_line")
    rows = pick(fn.filter("class_id is null"), "function").unionByName(pick(cls, "class")).unionByName(pick(fn.join(big, "class_id", "left_semi"), "method"))
    return rows.join(m, "module_id").join(n, "file_id").select("file_id", "kind", "id", "name", F.greatest(F.col("start_line") - before, F.lit(1)).alias("start_line"), F.least(F.col("end_line") + after, "n").alias("end_line"))


def merge_small(chunks: DataFrame, least: int = 10) -> DataFrame:
    """(file_id, start_line, end_line, members): runs of neighbours below ``least`` lines become one. A file's chunks are few."""
    w = Window.partitionBy("file_id").orderBy("start_line", "id")
    c = chunks.withColumn("small", F.col("end_line") - F.col("start_line") + 1 < least)
    c = c.withColumn("brk", F.when(F.col("small") & F.coalesce(F.lag("small").over(w), F.lit(False)), 0).otherwise(1))
    c = c.withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("file_id", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("members")).drop("island")


def prolog(contents: DataFrame, most: int = 50) -> DataFrame:
    """(file_id, end_line, code): a file's leading docstring, comments and imports, at most ``most`` lines; none if there are none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for fid, text in zip(pdf.file_id, pdf.content):
                lines, quote, end = text.split("\n"), None, 0
                for i, line in enumerate(lines[:most]):
                    s = line.strip()
                    if quote:
                        end = i + 1
                        if quote in s:
                            quote = None
                    elif s[:3] in ('"""', "'''"):
                        end = i + 1
                        if s.count(s[:3]) == 1:
                            quote = s[:3]
                    elif s.startswith(("#", "//", "/*", "*", "import ", "from ", "use ", "package ", "namespace ", "<?php")):
                        end = i + 1
                    elif s:
                        break
                if end and any(x.strip() not in ("", '"""', "'''", "/*", "*/") for x in lines[:end]):
                    rows.append((fid, end, "\n".join(lines[:end])))
            yield pd.DataFrame(rows, columns=["file_id", "end_line", "code"])

    return contents.filter(F.col("content").isNotNull()).select("file_id", "content").mapInPandas(read, "file_id long, end_line int, code string")


def by_characters(contents: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(file_id, chunk, code): pieces of whole lines of about ``size`` characters; each repeats trailing lines of up to ``overlap`` characters."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for fid, text in zip(pdf.file_id, pdf.content):
                now, n, k, fresh = [], 0, 0, False
                for line in text.split("\n"):
                    if now and fresh and n + len(line) + 1 > size:
                        rows.append((fid, k, "\n".join(now)))
                        k += 1
                        keep, m = [], 0
                        for x in reversed(now):
                            if m + len(x) + 1 > overlap:
                                break
                            keep.insert(0, x)
                            m += len(x) + 1
                        now, n, fresh = keep, m, False
                    now.append(line)
                    n += len(line) + 1
                    fresh = True
                if fresh:
                    rows.append((fid, k, "\n".join(now)))
            yield pd.DataFrame(rows, columns=["file_id", "chunk", "code"])

    return contents.filter(F.col("content").isNotNull()).select("file_id", "content").mapInPandas(read, "file_id long, chunk int, code string")
