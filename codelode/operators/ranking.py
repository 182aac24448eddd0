"""Scores of search results: the five-part final score, the criteria engine, greedy diversity."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the final score, and name parts that mark a popular function.
WEIGHTS = {"semantic": 0.6, "relevance": 0.2, "recency": 0.1, "popularity": 0.1}
POPULAR = ("init", "main", "get", "set", "create", "update", "delete", "process", "handle")


def recency(ts: Column, as_of: Column) -> Column:
    """By whole days of age: below 7 1.0, 30 0.8, 90 0.6, 365 0.4, else 0.2; unknown 0.5."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400)
    return F.when(ts.isNull(), 0.5).when(days < 7, 1.0).when(days < 30, 0.8).when(days < 90, 0.6).when(days < 365, 0.4).otherwise(0.2)


def popularity(name: Column, docstring: Column, methods: Column | None = None) -> Column:
    s = F.lit(0.5) + F.when(F.lower(name).rlike("|".join(POPULAR)), 0.2).otherwise(0.0) + F.when(docstring.isNotNull(), 0.1).otherwise(0.0)
    if methods is not None:
        s = s + F.when(methods > 10, 0.2).when(methods > 5, 0.1).otherwise(0.0)
    return F.least(s, F.lit(1.0))


def relevance(query: str, name: Column, docstring: Column, kind: str | None = None) -> Column:
    """Exact 1.0, substring 0.8, else shares of the query's words in name (0.5) and docstring (0.3), 0.2 for a named entity type."""
    q = query.lower()
    words = list(dict.fromkeys(q.split()))
    want = F.array(*map(F.lit, words))
    n = F.array_distinct(F.split(F.lower(name), "[_ ]"))
    d = F.array_distinct(F.split(F.lower(F.coalesce(docstring, F.lit(""))), r"\s+"))
    share = F.size(F.array_intersect(want, n)) * (0.5 / len(words)) + F.size(F.array_intersect(want, d)) * (0.3 / len(words))
    if kind and any(w in kind or w.rstrip("s") == kind for w in words):
        share = share + 0.2
    low = F.lower(name)
    return F.when(low == q, 1.0).when(low.contains(q), 0.8).otherwise(F.least(share, F.lit(1.0)))


def context(repository: Column, file: Column, name: Column, at: dict) -> Column:
    """0.5, and 0.2 for the same repository, 0.3 for the same file, 0.1 if one of the last five searches shares a word with the name."""
    if not at:
        return F.lit(0.5)
    words = [w for s in at.get("recent", [])[-5:] for w in s.lower().replace(" ", "_").split("_") if w]
    near = F.arrays_overlap(F.split(F.lower(name), "_"), F.array(*map(F.lit, words))) if words else F.lit(False)
    same = lambda c, k: F.coalesce(c == F.lit(at.get(k)), F.lit(False))
    return F.least(F.lit(0.5) + F.when(same(repository, "repository_id"), 0.2).otherwise(0.0) + F.when(same(file, "file_id"), 0.3).otherwise(0.0) + F.when(near, 0.1).otherwise(0.0), F.lit(1.0))


def final(semantic: Column, relevance_: Column, recency_: Column, popularity_: Column, context_: Column | None = None, weights: dict[str, float] | None = None) -> Column:
    """The weighted sum; weights of the parts given must add up to one."""
    w = dict(weights or WEIGHTS)
    if abs(sum(w.values()) - 1) > 1e-3:
        raise ValueError("weights must add up to 1")
    parts = {"semantic": semantic, "relevance": relevance_, "recency": recency_, "popularity": popularity_, "context": context_}
    out = F.lit(0.0)
    for k, v in w.items():
        if parts[k] is not None:
            out = out + parts[k] * v
    return out


@dataclass
class Criteria:
    """Weights of the criteria engine, each in [0, 1]."""

    similarity: float = 0.0
    complexity: float = 0.0
    recency: float = 0.0
    docstring: float = 0.0
    size: float = 0.0
    path: float = 0.0
    prefer_simple: bool = False
    prefer_concise: bool = False
    preferred_path: str | None = None
    boost_imports: tuple[str, ...] = ()
    import_boost: float = 0.2
    exclude_tests: bool = False
    min_similarity: float | None = None
    diversity: float = 0.0
    scorer: Callable[[DataFrame], Column] | None = None

    def check(self) -> None:
        for k in ("similarity", "complexity", "recency", "docstring", "size", "path", "diversity"):
            if not 0 <= getattr(self, k) <= 1:
                raise ValueError("Weights must be between 0 and 1")


def rank(results: DataFrame, c: Criteria, as_of: Column | None = None) -> DataFrame:
    """results (file_id, file_path, similarity, complexity, lines, last_modified, imports, has_docstring) with ``score``, best first.

    Columns are normalised over the filtered rows; a constant column gives 0. The bounds are one row, a scalar
    subquery, so no window over all rows is needed.
    """
    c.check()
    r = results
    if c.exclude_tests:
        r = r.filter(~F.col("file_path").startswith("tests/"))
    if c.min_similarity is not None:
        r = r.filter(F.col("similarity") >= c.min_similarity)
    age = -(F.unix_timestamp(as_of if as_of is not None else F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp("last_modified"))
    r = r.withColumn("_age", age)
    cols = ["similarity", "complexity", "lines", "_age"]
    bounds = r.agg(F.struct(*[f(x).alias(f"{n}_{x}") for x in cols for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    r = r.withColumn("_b", bounds)

    def unit(x: str) -> Column:
        lo, hi = F.col("_b")[f"lo_{x}"], F.col("_b")[f"hi_{x}"]
        return F.coalesce(F.when(lo == hi, 0.0).otherwise((F.col(x) - lo) / (hi - lo)), F.lit(0.0))

    s = F.lit(0.0)
    if c.similarity:
        s = s + unit("similarity") * c.similarity
    if c.complexity:
        s = s + ((1 - unit("complexity")) if c.prefer_simple else unit("complexity")) * c.complexity
    if c.recency:
        s = s + F.when(F.col("_age").isNull(), 0.0).otherwise(unit("_age")) * c.recency
    if c.docstring:
        s = s + F.when(F.col("has_docstring"), 1.0).otherwise(0.0) * c.docstring
    if c.size:
        s = s + ((1 - unit("lines")) if c.prefer_concise else unit("lines")) * c.size
    if c.path and c.preferred_path:
        s = s + F.when(F.contains("file_path", F.lit(c.preferred_path)), 1.0).otherwise(0.0) * c.path
    if not any((c.similarity, c.complexity, c.recency, c.docstring, c.size, c.path, c.boost_imports, c.scorer)):
        s = F.col("similarity")
    if c.boost_imports:
        s = s + F.when(F.arrays_overlap("imports", F.array(*map(F.lit, c.boost_imports))), c.import_boost).otherwise(0.0)
        if not c.similarity:
            s = s + F.col("similarity") * 0.0
    if c.scorer is not None:
        s = s + F.coalesce(c.scorer(r), F.lit(0.0))
    out = r.withColumn("score", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))).drop("_age", "_b")
    return out.orderBy(F.desc("score"), "file_id")


def diversify(ranked: DataFrame, factor: float = 0.3, most: int | None = None) -> DataFrame:
    """The rows of each query (query_id, file_id, file_path, score), picked greedily: a directory met before costs.

    Sequential by nature: one query's rows are one group. ``most`` keeps only its first rows by score.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "file_id"], ascending=[False, True]).head(len(pdf) if most is None else most).reset_index(drop=True)
        rows: dict[str, list[int]] = {}
        for i, p in enumerate(pdf.file_path):
            rows.setdefault("/".join(p.split("/")[:2]), []).append(i)
        score, order = pdf.score.tolist(), []
        # a pick only changes what its own directory's rows are worth, and they stay in order: the next of each is enough
        next_of = [(-score[at[0]], at[0], d, 0) for d, at in rows.items()]
        heapq.heapify(next_of)
        while next_of:
            _, i, d, n = heapq.heappop(next_of)
            order.append(i)
            if n + 1 < len(rows[d]):
                j = rows[d][n + 1]
                heapq.heappush(next_of, (-score[j] * (1 - min((n + 2) * factor, 0.9)), j, d, n + 1))
        out = pdf.loc[order].copy()
        out["position"] = range(1, len(out) + 1)
        return out[["query_id", "file_id", "file_path", "score", "position"]]

    return ranked.select("query_id", "file_id", "file_path", "score").groupBy("query_id").applyInPandas(pick, "query_id long, file_id long, file_path string, score double, position int")
