"""Graph queries: components, cycles, communities, hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import graph as gr
from codelode.operators import vectors as vx

from .base import Data, query
from .rules import PAIRS, relations


def embedding_edges(d: Data):
    return vx.pairs_above(d.embeddings, 0.4).select(F.col("a").alias("source"), F.col("b").alias("target"))


EDGE = "e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.4)"


@query(f"WITH RECURSIVE {EDGE}, u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY id")
def gr7_components(d: Data):
    return gr.components(d.embeddings.select(F.col("vec_id").alias("id")), embedding_edges(d))


STRONG = f"{PAIRS}, e AS (SELECT source AS s, target AS t FROM pair WHERE n > 1.5 * (SELECT avg(n) FROM pair))"


def strong_edges(d: Data):
    from codelode.operators.rules import _with_mean, pair_counts

    return _with_mean(pair_counts(relations(d))).filter("n > 1.5 * mean").select("source", "target", "n", "types")


@query(
    f"""WITH {STRONG}, c2 AS (SELECT [a.s, a.t] AS path, 2 AS length FROM e a JOIN e b ON b.s = a.t AND b.t = a.s WHERE a.s < a.t),
    c3 AS (SELECT [a.s, b.s, c.s] AS path, 3 AS length FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t AND c.t = a.s WHERE a.s < b.s AND a.s < c.s AND b.s <> c.s),
    c4 AS (SELECT [a.s, b.s, c.s, g.s] AS path, 4 AS length FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t JOIN e g ON g.s = c.t AND g.t = a.s WHERE a.s < b.s AND a.s < c.s AND a.s < g.s AND b.s <> c.s AND b.s <> g.s AND c.s <> g.s)
    SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4"""
)
def gr14_cycles(d: Data):
    return gr.cycles(strong_edges(d), 4)


@query(f"WITH RECURSIVE {STRONG}, r AS (SELECT n_nationkey AS id, 0 AS hops FROM nation WHERE n_regionkey = 0 UNION SELECT e.t, r.hops + 1 FROM r JOIN e ON e.s = r.id WHERE r.hops < 3) SELECT id, min(hops) AS hops FROM r GROUP BY id")
def gr22_k_hop(d: Data):
    return gr.k_hop(strong_edges(d), d.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("id")), 3)


@query(f"WITH {PAIRS} SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS links, sum(n)::BIGINT AS weight FROM pair GROUP BY 1, 2")
def gr5_context_edges(d: Data):
    from codelode.operators.rules import pair_counts

    return pair_counts(relations(d)).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("links"), F.sum("n").alias("weight"))


@query(f"WITH {PAIRS}, t AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(n) AS n, list_distinct(flatten(list(types))) AS types FROM pair GROUP BY 1, 2) SELECT a, b, CASE WHEN list_contains(types, 'R') THEN 'published_language' WHEN list_contains(types, 'A') THEN 'customer_supplier' WHEN n > 5 THEN 'shared_kernel' ELSE 'partnership' END AS relationship FROM t")
def gr6_relationship_type(d: Data):
    from codelode.operators.rules import pair_counts

    names = F.create_map(*[F.lit(x) for x in ("R", "publishes", "A", "orchestrates", "N", "uses")])
    t = pair_counts(relations(d)).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    return t.select("a", "b", gr.relationship_type(F.transform("types", lambda x: names[x]), F.col("n")).alias("relationship"))


@query(
    """WITH m AS (SELECT c_custkey AS id, c_nationkey AS community FROM customer), o AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS a, greatest(o_custkey, l_suppkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey),
    e AS (SELECT x.community AS ca, y.community AS cb FROM o JOIN m x ON x.id = o.a JOIN m y ON y.id = o.b), n AS (SELECT community, count(*) AS size FROM m GROUP BY 1),
    g AS (SELECT n.community, n.size, (SELECT count(*) FROM e WHERE ca = cb AND ca = n.community) AS internal, (SELECT count(*) FROM e WHERE ca <> cb AND (ca = n.community OR cb = n.community)) AS external_edges FROM n)
    SELECT community, size, internal, external_edges, round(CASE WHEN size > 1 THEN internal / (size * (size - 1) / 2.0::DOUBLE) ELSE 1.0 END, 6) AS cohesion, round(external_edges / (2.0::DOUBLE * size), 6) AS coupling,
    round(round(CASE WHEN size > 1 THEN internal / (size * (size - 1) / 2.0::DOUBLE) ELSE 1.0 END, 6) - round(external_edges / (2.0::DOUBLE * size), 6), 6) AS modularity FROM g"""
)
def gr3_context_metrics(d: Data):
    o = d.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    e = d.lineitem.select("l_orderkey", "l_suppkey").join(o, "l_orderkey").filter("o_custkey <> l_suppkey").select(F.least("o_custkey", "l_suppkey").alias("a"), F.greatest("o_custkey", "l_suppkey").alias("b")).distinct()
    return gr.context_metrics(e, d.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")))


@query()
def gr2_communities(d: Data):
    e = vx.pairs_above(d.embeddings, 0.3).select("a", "b", F.col("similarity").alias("weight"))
    return gr.communities(e)


@query("SELECT r.r_name AS region, n.n_name AS nation, count(c.c_custkey) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def gr18_hierarchy_rollup(d: Data):
    c = d.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return d.region.join(d.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left").select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), "balance")


@query("WITH RECURSIVE e AS (SELECT DISTINCT c.name, b.base FROM classes c, unnest(c.base_classes) AS b(base)), r AS (SELECT name, base, 1 AS depth FROM e UNION SELECT r.name, e.base, r.depth + 1 FROM r JOIN e ON e.name = r.base WHERE r.depth < 10) SELECT name, max(depth) AS depth, bool_or(name = base) AS circular FROM r GROUP BY 1", "classes")
def gr15_inheritance(d: Data):
    e = d.classes.select("name", F.explode("base_classes").alias("base")).distinct()
    step = e.select(F.col("name").alias("base"), F.col("base").alias("next"))
    level = e.select("name", "base", F.lit(1).alias("depth"))
    out = level
    for n in range(2, 11):
        level = level.join(step, "base").select("name", F.col("next").alias("base"), F.lit(n).alias("depth")).distinct()
        out = out.unionByName(level)
    return out.groupBy("name").agg(F.max("depth").alias("depth"), F.bool_or(F.col("name") == F.col("base")).alias("circular"))


@query(f"WITH {PAIRS}, x AS (SELECT source AS node, count(*) AS outgoing FROM pair WHERE n > (SELECT 1.2 * avg(n) FROM pair) GROUP BY 1), y AS (SELECT target AS node, count(*) AS incoming FROM pair WHERE n > (SELECT 1.2 * avg(n) FROM pair) GROUP BY 1) SELECT n_nationkey AS node, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) + coalesce(incoming, 0) = 0 AS isolated FROM nation LEFT JOIN x ON x.node = n_nationkey LEFT JOIN y ON y.node = n_nationkey")
def agg20_degrees(d: Data):
    from codelode.operators.rules import _with_mean, pair_counts

    e = _with_mean(pair_counts(relations(d))).filter("n > 1.2 * mean")
    o, i = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("outgoing")), e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("incoming"))
    g = d.nation.select(F.col("n_nationkey").alias("node")).join(o, "node", "left").join(i, "node", "left").fillna(0)
    return g.withColumn("isolated", F.col("outgoing") + F.col("incoming") == 0)
