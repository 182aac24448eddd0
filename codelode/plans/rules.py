"""The rule engine: coupling of contexts, anti-patterns, evolution, health, smells.

Contexts are nations, entities suppliers and customers, relations line items; thresholds that count are multiples of the
mean where a constant would select all or nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions.text import is_camel, is_snake
from codelode.operators import rules as rl

from .base import Data, query


def relations(d: Data):
    """(source, target, type) of every line item: the supplier's nation, the customer's nation, the return flag."""
    s = d.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source"))
    c = d.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target"))
    o = d.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return d.lineitem.select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("type")).join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").select("source", "target", "type")


REL = "rel AS (SELECT s.s_nationkey AS source, c.c_nationkey AS target, l.l_returnflag AS type FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey)"
PAIRS = f"{REL}, pair AS (SELECT source, target, count(*) AS n, list_sort(list(DISTINCT type)) AS types FROM rel WHERE source <> target GROUP BY 1, 2)"


@query(f"WITH {REL}, e AS (SELECT s_nationkey AS context, count(*) AS entities FROM supplier GROUP BY 1), o AS (SELECT source AS context, count(*) FILTER (WHERE source <> target) AS outgoing FROM rel GROUP BY 1) SELECT e.context, e.entities, coalesce(o.outgoing, 0) AS outgoing, round(coalesce(o.outgoing, 0)::DOUBLE / greatest(e.entities, 1), 2) AS score FROM e LEFT JOIN o ON o.context = e.context")
def dom1_coupling(d: Data):
    return rl.coupling(relations(d), d.supplier.select(F.col("s_nationkey").alias("context")))


@query(f"WITH {PAIRS}, m AS (SELECT 1.2 * avg(n) AS high, avg(n) AS mid FROM pair) SELECT source, target, n, CASE WHEN n > high AND list_contains(types, 'R') THEN 'orchestration' WHEN n > high AND list_contains(types, 'A') THEN 'dependency' WHEN n > high THEN 'strong' WHEN n > mid THEN 'moderate' ELSE 'acceptable' END AS advice FROM pair, m")
def dom2_recommendation(d: Data):
    return rl.advice(rl.pair_counts(relations(d)))


@query(f"WITH {PAIRS}, m AS (SELECT 1.2 * avg(n) AS high, 0.8 * avg(n) AS low FROM pair) SELECT p.source, p.target, p.n FROM pair p CROSS JOIN m LEFT JOIN pair q ON q.source = p.target AND q.target = p.source WHERE p.n > m.high AND coalesce(q.n, 0) < m.low")
def dom3_one_way_pairs(d: Data):
    return rl.one_way(rl.pair_counts(relations(d)))


@query(f"WITH {REL} SELECT source AS context, count(*) AS n, count(*) FILTER (WHERE source <> target) AS external_relations FROM rel GROUP BY 1 HAVING count(*) > 20")
def agg22_chatty(d: Data):
    return relations(d).groupBy(F.col("source").alias("context")).agg(F.count("*").alias("n"), F.count_if(F.col("source") != F.col("target")).alias("external_relations")).filter("n > 20")


@query("SELECT l_partkey AS entity, count(DISTINCT s_nationkey) AS contexts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 2")
def agg23_shared_kernel(d: Data):
    s = d.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return d.lineitem.select("l_partkey", "l_suppkey").join(s, "l_suppkey").select(F.col("l_partkey").alias("entity"), "s_nationkey").distinct().groupBy("entity").agg(F.count("*").alias("contexts")).filter("contexts > 2")


@query(
    """WITH n AS (SELECT class_id, count(*) AS methods FROM functions WHERE class_id IS NOT NULL GROUP BY 1), x AS (SELECT c.id, c.name, coalesce(n.methods, 0) AS methods, len(c.base_classes) AS bases, c.docstring FROM classes c LEFT JOIN n ON n.class_id = c.id)
    SELECT 'anemic' AS pattern, 'medium' AS severity, id FROM x WHERE methods = 0 UNION ALL SELECT 'god_object', 'high', id FROM x WHERE methods > 7 UNION ALL SELECT 'missing_root', 'medium', id FROM x WHERE coalesce(bases, 0) = 0 AND methods > 0 AND docstring IS NULL""",
    "classes functions",
)
def dom4_anti_patterns(d: Data):
    return rl.anti_patterns(d.classes, d.functions)


@query(
    """WITH n AS (SELECT class_id, count(*) AS methods FROM functions WHERE class_id IS NOT NULL GROUP BY 1), x AS (SELECT c.id, coalesce(n.methods, 0) AS methods, len(c.base_classes) AS bases, c.docstring FROM classes c LEFT JOIN n ON n.class_id = c.id),
    a AS (SELECT 'medium' AS severity FROM x WHERE methods = 0 UNION ALL SELECT 'high' FROM x WHERE methods > 7 UNION ALL SELECT 'medium' FROM x WHERE coalesce(bases, 0) = 0 AND methods > 0 AND docstring IS NULL)
    SELECT count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, (100 - (10 * count(*) FILTER (WHERE severity = 'high') + 5 * count(*) FILTER (WHERE severity = 'medium')))::BIGINT AS health FROM a""",
    "classes functions",
)
def dom7_severity_and_health(d: Data):
    return rl.health_b(rl.anti_patterns(d.classes, d.functions))


@query(f"WITH {PAIRS}, c AS (SELECT avg(n)::DOUBLE AS coupling, count(*) FILTER (WHERE n > 1.5 * (SELECT avg(n) FROM pair)) AS pairs FROM pair) SELECT round(coupling, 4) AS coupling, pairs, greatest(0.0, least(100.0, 100.0 - CASE WHEN coupling > 5 THEN 30 WHEN coupling > 3 THEN 20 WHEN coupling > 1 THEN 10 ELSE 0 END - 3 * least(pairs, 10)))::DOUBLE AS health FROM c")
def dom6_health(d: Data):
    return rl.health_a(rl.pair_counts(relations(d)))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS added, round(100.0::DOUBLE * count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) / count(*), 1) AS growth FROM events GROUP BY 1")
def dom5_evolution(d: Data):
    return rl.evolution(d.events, "event_type", "ts", "2024-01-31 00:00:00", 7)


@query(
    """SELECT id, 'long' AS smell FROM functions WHERE end_line - start_line + 1 > 50 UNION ALL SELECT id, 'parameters' FROM functions WHERE len(parameters) > 5 UNION ALL SELECT id, 'undocumented' FROM functions WHERE docstring IS NULL UNION ALL SELECT id, 'name' FROM functions WHERE NOT regexp_matches(name, '^[a-z][a-z0-9_]*$')""",
    "functions",
)
def dom11_function_smells(d: Data):
    return rl.function_smells(d.functions, is_snake)


@query(
    """WITH n AS (SELECT class_id, count(*) AS methods FROM functions WHERE class_id IS NOT NULL GROUP BY 1), x AS (SELECT c.*, n.methods FROM classes c LEFT JOIN n ON n.class_id = c.id)
    SELECT id, 'long' AS smell FROM x WHERE end_line - start_line + 1 > 200 UNION ALL SELECT id, 'methods' FROM x WHERE methods > 20 UNION ALL SELECT id, 'undocumented' FROM x WHERE docstring IS NULL UNION ALL SELECT id, 'name' FROM x WHERE NOT regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$')""",
    "classes functions",
)
def dom12_class_smells(d: Data):
    return rl.class_smells(d.classes, d.functions, is_camel)


@query("SELECT id, 'undocumented' AS smell FROM modules WHERE docstring IS NULL", "modules")
def dom13_module_smells(d: Data):
    return d.where("modules", "docstring is null").select("id", F.lit("undocumented").alias("smell"))


@query("SELECT m.id, count(DISTINCT c.id) AS classes, count(DISTINCT f.id) FILTER (WHERE f.class_id IS NULL) AS functions, concat('Module ', m.name, ' containing ', count(DISTINCT c.id), ' classes and ', count(DISTINCT f.id) FILTER (WHERE f.class_id IS NULL), ' functions') AS summary FROM modules m LEFT JOIN classes c ON c.module_id = m.id LEFT JOIN functions f ON f.module_id = m.id GROUP BY m.id, m.name", "modules classes functions")
def dom18_module_summary(d: Data):
    c = d.classes.groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("classes"))
    f = d.functions.groupBy(F.col("module_id").alias("id")).agg(F.count_if(F.col("class_id").isNull()).alias("functions"))
    g = d.modules.select("id", "name").join(c, "id", "left").join(f, "id", "left").fillna(0, ["classes", "functions"])
    return g.select("id", "classes", "functions", F.format_string("Module %s containing %d classes and %d functions", "name", "classes", "functions").alias("summary"))


@query("SELECT f.id, concat_ws('. ', concat('Function ', f.name), substr(nullif(trim(f.docstring), ''), 1, 200)) AS explanation FROM functions f", "functions")
def dom15_explain_function(d: Data):
    return d.functions.select("id", F.concat_ws(". ", F.concat(F.lit("Function "), "name"), F.substring(F.nullif(F.trim("docstring"), F.lit("")), 1, 200)).alias("explanation"))


@query(f"WITH {PAIRS} SELECT concat('C', source, ' -->|', n, '| C', target) AS line FROM pair WHERE n > (SELECT 1.2 * avg(n) FROM pair)")
def snk16_mermaid_lines(d: Data):
    return rl.mermaid(rl.pair_counts(relations(d)))
