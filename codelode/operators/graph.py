"""Graphs as vertex and edge DataFrames: components, cycles, communities, context metrics.

Loops run on the driver, joins on the executors; every few rounds the state is checkpointed to the shared folder, which
cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import shared_dir


def undirected(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Both directions of every edge, loops and repeats dropped."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each connected component; vertices without edges are their own.

    Alternates large-star and small-star, so a chain of n vertices takes O(log n) rounds, and no vertex gathers its
    neighbours as a list: each round only takes minima, which combine before the shuffle.
    """
    shared_dir(vertices.sparkSession)
    e = edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        e = small.checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return vertices.select("id").join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(path, length) of all elementary cycles of up to ``longest`` edges, each once, starting at its smallest vertex.

    Paths grow by one equi join a round; a path only takes vertices above its start that it does not hold yet.
    """
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).filter("s <> t").distinct()
    paths = e.filter("s < t").select(F.array("s", "t").alias("path"), F.col("s").alias("first"), F.col("t").alias("last"))
    found = None
    for n in range(2, longest + 1):
        closed = paths.join(e.select(F.col("s").alias("last"), F.col("t").alias("first")), ["first", "last"], "left_semi").select("path", F.lit(n).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            step = e.select(F.col("s").alias("last"), F.col("t").alias("next"))
            paths = paths.join(step, "last").filter((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), "first", F.col("next").alias("last"))
    return found


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops): what the starting ids reach along the edges in at most ``depth`` steps, with the fewest."""
    reached = start.select("id", F.lit(0).alias("hops"))
    front = reached
    for n in range(1, depth + 1):
        front = front.select("id").join(edges.select(F.col("source").alias("id"), F.col("target").alias("to")), "id").select(F.col("to").alias("id")).distinct().join(reached.select("id"), "id", "left_anti").select("id", F.lit(n).alias("hops"))
        reached = reached.unionByName(front)
    return reached


def build(entities: DataFrame, relations: DataFrame, confidence: float = 0.5, strength: float = 0.5, weak: bool = False) -> DataFrame:
    """(a, b, weight) of the undirected graph: confident ends and relations, weight strength x confidence, the last of repeats kept."""
    v = entities.filter(F.col("confidence") >= confidence).select("id")
    r = relations.filter(F.col("confidence") >= confidence)
    if not weak:
        r = r.filter(F.col("strength") >= strength)
    r = r.join(v.select(F.col("id").alias("source")), "source", "left_semi").join(v.select(F.col("id").alias("target")), "target", "left_semi")
    return r.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max_by(F.col("strength") * F.col("confidence"), "id").alias("weight")).filter("a <> b")


#: Weights count in whole millionths, so sums and comparisons are exact and don't depend on their order.
UNIT = 1_000_000
#: The parts of the proposed moves that are tried before the best one alone: 1/2, 1/4, ... 1/PARTS.
PARTS = 64


def communities(edges: DataFrame, rounds: int | None = None, small: int = 50_000) -> DataFrame:
    """(id, community) of a weighted graph (a, b, weight): Louvain with passes in which vertices move at the same time.

    In a pass every vertex that would raise modularity elsewhere proposes its best move, ties going to the smaller
    community. Half of the proposals, by hash, are made together; if that doesn't raise modularity, a quarter and so on,
    at last the best alone. A level ends when no vertex proposes a move (or after ``rounds`` passes); communities become
    vertices, until a level moves nothing. Up to ``small`` edges, checked by a count, one task does this, beyond that
    DataFrames do; both give the same communities.
    """
    if edges.limit(small + 1).count() <= small:
        return edges.select(F.lit(0).alias("g"), "a", "b", "weight").groupBy("g").applyInPandas(lambda pdf: louvain(pdf, rounds=rounds), "id long, community long")
    shared_dir(edges.sparkSession)
    one = edges.select("a", "b", F.floor(F.col("weight") * UNIT + 0.5).cast("long").alias("q"))
    near = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "q")).groupBy("a", "b").agg(F.sum("q").alias("q")).checkpoint()
    member = near.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")).checkpoint()
    while True:
        v, moved = _level(near, rounds)
        if not moved:
            return member
        names = v.join(v.groupBy("community").agg(F.min("id").alias("name")), "community").select("id", "name").checkpoint()
        member = member.join(names.withColumnRenamed("id", "community"), "community").select("id", F.col("name").alias("community")).checkpoint()
        ends = near.join(names.select(F.col("id").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
        near = ends.groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("q").alias("q")).checkpoint()


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _level(near: DataFrame, rounds: int | None) -> tuple[DataFrame, bool]:
    """(id, k: degree, community) after the passes of one level over both directions (a, b, q); whether any vertex moved."""
    v = near.groupBy(F.col("a").alias("id")).agg(F.sum("q").alias("k")).withColumn("community", F.col("id")).checkpoint()
    total = v.agg(F.sum("k")).first()[0] or 0

    def score(v: DataFrame) -> int:
        label = v.select("id", "community")
        both = near.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").filter("ca = cb").agg(F.sum("q")).first()[0] or 0
        return total * both - int(v.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(_wide("t") * _wide("t"))).first()[0] or 0)

    now, n = score(v), 0
    while rounds is None or n < rounds:
        links = near.filter("a <> b").join(v.select(F.col("id").alias("b"), F.col("community").alias("c")), "b").select("a", "c", "q")
        links = links.unionByName(v.select(F.col("id").alias("a"), F.col("community").alias("c"), F.lit(0).cast("long").alias("q"))).groupBy("a", "c").agg(F.sum("q").alias("w"))
        links = links.join(v.select(F.col("id").alias("a"), "k", F.col("community").alias("own")), "a").join(v.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("t")), "c")
        gain = _wide(F.lit(total)) * _wide("w") - _wide(F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)) * _wide("k")
        best = links.withColumn("gain", gain).groupBy(F.col("a").alias("id")).agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("next"), F.max("gain").alias("gain"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        moves = best.filter("gain > stay").select("id", "next", (F.col("gain") - F.col("stay")).alias("rise")).checkpoint()
        if moves.isEmpty():
            break
        part = 2
        while True:
            some = moves.filter(F.pmod(F.xxhash64("id", F.lit(n).cast("long")), F.lit(part)) == 0)
            if part > PARTS or some.isEmpty():
                part, some = PARTS + 1, moves.orderBy(F.desc("rise"), "id").limit(1)
            then = v.join(some.select("id", "next"), "id", "left").select("id", "k", F.coalesce("next", "community").alias("community")).checkpoint()
            got = score(then)
            if got > now or part > PARTS:
                break
            part *= 2
        v, now, n = then, got, n + 1
    return v, n > 0


def louvain(pdf: pd.DataFrame, resolution: float = 1.0, rounds: int | None = None) -> pd.DataFrame:
    """What ``communities`` does, in memory."""
    import xxhash

    up, down = float(resolution).as_integer_ratio()
    near: dict[int, dict[int, int]] = {}
    for a, b, w in zip(pdf.a, pdf.b, pdf.weight):
        a, b, q = int(a), int(b), math.floor(w * UNIT + 0.5)
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + q
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + q
    member = {v: v for v in near}
    graph = near
    while True:
        degree = {v: sum(n.values()) for v, n in graph.items()}
        total = sum(degree.values())
        first = {v: xxhash.xxh64_intdigest(struct.pack("<q", v), seed=42) for v in graph}

        def sizes(where: dict[int, int], degree=degree) -> dict[int, int]:
            out: dict[int, int] = {}
            for v, c in where.items():
                out[c] = out.get(c, 0) + degree[v]
            return out

        def score(where: dict[int, int], graph=graph, total=total, sizes=sizes) -> int:
            both = sum(w for v, n in graph.items() for u, w in n.items() if where[u] == where[v])
            return down * total * both - up * sum(t * t for t in sizes(where).values())

        where = {v: v for v in graph}
        now, n = score(where), 0
        while rounds is None or n < rounds:
            inside, moves = sizes(where), []
            for v, around in graph.items():
                own, k = where[v], degree[v]
                links = {own: 0}
                for u, w in around.items():
                    if u != v:
                        links[where[u]] = links.get(where[u], 0) + w
                gain = {c: down * total * w - up * (inside[c] - (k if c == own else 0)) * k for c, w in links.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] > gain[own]:
                    moves.append((gain[best] - gain[own], v, best))
            if not moves:
                break
            part = 2
            while True:
                some = [m for m in moves if xxhash.xxh64_intdigest(struct.pack("<q", n), seed=first[m[1]]) % part == 0]
                if part > PARTS or not some:
                    part, some = PARTS + 1, [min(moves, key=lambda m: (-m[0], m[1]))]
                then = where | {v: c for _, v, c in some}
                got = score(then)
                if got > now or part > PARTS:
                    break
                part *= 2
            where, now, n = then, got, n + 1
        if not n:
            return pd.DataFrame({"id": list(member), "community": list(member.values())}).astype("int64")
        names: dict[int, int] = {}
        for v in sorted(graph):
            names.setdefault(where[v], v)
        member = {v: names[where[c]] for v, c in member.items()}
        merged: dict[int, dict[int, int]] = {}
        for v, around in graph.items():
            for u, w in around.items():
                a, b = names[where[v]], names[where[u]]
                merged.setdefault(a, {})[b] = merged.setdefault(a, {}).get(b, 0) + w
        graph = merged


def context_metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, size, internal, external, cohesion, coupling, modularity) from edges (a, b) and members (id, community)."""
    m = members.select("id", "community")
    e = edges.join(m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("inside"))
    counts = ends.groupBy("community").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external_edges"))
    n = m.groupBy("community").agg(F.count("*").alias("size"))
    g = n.join(counts, "community", "left").select("community", "size", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external_edges", F.lit(0)).alias("external_edges"))
    most = F.col("size") * (F.col("size") - 1) / 2
    g = g.withColumn("cohesion", F.round(F.when(most > 0, F.col("internal") / F.nullif(most, F.lit(0.0))).otherwise(1.0), 6)).withColumn("coupling", F.round(F.col("external_edges") / (2 * F.col("size")), 6))
    return g.withColumn("modularity", F.round(F.col("cohesion") - F.col("coupling"), 6))


def relationship_type(types: Column, count: Column) -> Column:
    """The type of a link between contexts, by the relation types it holds, in this order."""
    has = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    return F.when(has("publishes", "subscribes_to"), "published_language").when(has("orchestrates"), "customer_supplier").when(count > 5, "shared_kernel").when(has("validates"), "anti_corruption_layer").otherwise("partnership")


def context_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(left, right, links, strength, types, relationship) of each pair of communities, from edges (a, b, weight, type)."""
    m = members.select("id", "community")
    e = edges.join(m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").filter("ca <> cb")
    g = e.groupBy(F.least("ca", "cb").alias("left"), F.greatest("ca", "cb").alias("right")).agg(F.count("*").alias("links"), F.round(F.sum("weight") / F.count("*"), 6).alias("strength"), F.array_sort(F.collect_set("type")).alias("types"))
    return g.withColumn("relationship", relationship_type(F.col("types"), F.col("links")))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target) file ids from imports (file_id, repository_id, module_name): the importer and the repository's file of that module."""
    name = F.replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    local = files.groupBy("repository_id", name.alias("module_name")).agg(F.min("id").alias("target"))
    return imports.select(F.col("file_id").alias("source"), "repository_id", "module_name").join(local, ["repository_id", "module_name"]).filter("source <> target").select("source", "target").distinct()


def cycle_core(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id): the vertices on a way from a cycle to a cycle, of any length; none if and only if there is no cycle.

    Vertices that nothing leads to or that lead nowhere are taken off until none is left of them. ``cycles`` stops at a
    length; what is here and not in its paths lies on longer cycles or between cycles.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).filter("s <> t").distinct().checkpoint()
    n = e.count()
    for _ in range(rounds):
        for _ in range(3):
            e = e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi")
            e = e.join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
        e = e.checkpoint()
        left = e.count()
        if left == n:
            return e.select(F.col("s").alias("id")).unionByName(e.select(F.col("t").alias("id"))).distinct()
        n = left
    raise RuntimeError(f"the core of cycles did not settle in {rounds} rounds")
