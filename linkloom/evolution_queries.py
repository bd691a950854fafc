"""Queries for evolutionary search: populations, operators on them, fronts, and a search over all scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators import evolve
from linkloom.operators import links as L
from linkloom.operators import metrics as M
from linkloom.plans import domain as D
from linkloom.queries import _PRF, _rounded, query
from linkloom.runtime import load, materialize

_POINTS = "pt AS (SELECT l_orderkey AS ind, sum(l_quantity) AS a, round(sum(l_discount), 4) AS b FROM lineitem GROUP BY 1)"
#: Orders as individuals, their lines as links.
_POP = "pop AS (SELECT DISTINCT l_orderkey AS ind, l_partkey AS req, l_suppkey AS code FROM lineitem)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ind")).agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_discount"), 4).alias("b"))


def population(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("ind"), F.col("l_partkey").alias("req"), F.col("l_suppkey").alias("code")).distinct()


@query("jn16_domination", f"WITH {_POINTS} SELECT count(*) AS pairs FROM pt x JOIN pt y ON x.a >= y.a AND x.b >= y.b AND (x.a > y.a OR x.b > y.b)")
def jn16(spark, d):
    """Pairs of points of which the first dominates the second, over all points."""
    return evolve.dominations(points(spark, d), "a", "b")


@query("ns04_front1", f"WITH {_POINTS} SELECT ind, a, b FROM pt x WHERE NOT EXISTS (SELECT 1 FROM pt y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))")
def ns04_first(spark, d):
    return evolve.first_front(points(spark, d), ["a", "b"])


@query("ns04_fronts", f"WITH RECURSIVE {_POINTS}, p AS (SELECT row_number() OVER (ORDER BY a DESC, b DESC) AS r, a, b FROM (SELECT DISTINCT a, b FROM pt)), rec(r, low, front) AS (SELECT 0::BIGINT, []::DOUBLE[], 0::BIGINT UNION ALL SELECT r, low[1:k - 1] || [b] || low[k + 1:], k FROM (SELECT p.r, p.b, low, coalesce(list_position(list_transform(low, lambda x: x < p.b), true), len(low) + 1)::BIGINT AS k FROM rec JOIN p ON p.r = rec.r + 1)) SELECT ind, a, b, front::INTEGER AS front FROM pt JOIN p USING (a, b) JOIN rec USING (r)")
def ns04(spark, d):
    """All points with the number of their front."""
    return evolve.fronts_of_two(points(spark, d), "a", "b")


@query("ga02_initial", f"WITH {_POP}, pool AS (SELECT row_number() OVER (ORDER BY req, code) AS pos, req, code FROM (SELECT DISTINCT ps.l_partkey AS req, ps.l_suppkey AS code FROM lineitem ps)), sz AS (SELECT o_orderkey AS ind, 4 AS size FROM orders), have AS (SELECT ind, req, code, pos, 0 AS new FROM pop JOIN pool USING (req, code)), offer AS (SELECT ind, req, code, pos, 1 AS new FROM sz JOIN pool ON pos <= size), l AS (SELECT * FROM have UNION ALL SELECT o.* FROM offer o WHERE NOT EXISTS (SELECT 1 FROM pop p WHERE p.ind = o.ind AND p.req = o.req AND p.code = o.code)) SELECT ind, req, code FROM (SELECT l.*, size, row_number() OVER (PARTITION BY ind ORDER BY new, pos) AS r FROM l JOIN sz USING (ind)) WHERE r <= size")
def ga02(spark, d):
    """Individuals of four links each: larger ones cut, smaller ones filled from the pool of all pairs."""
    pop = population(spark, d)
    pool = evolve.numbered(pop.select("req", "code").distinct(), ["req", "code"])
    return evolve.trimmed(pop, pool, load(spark, d, "orders").select(F.col("o_orderkey").alias("ind"), F.lit(4).alias("size")))


_COUPLES = "cp AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0)"


@query("ga03_crossover", f"WITH {_POP}, {_COUPLES}, mate AS (SELECT a AS ind, b AS mate FROM cp UNION ALL SELECT b, a FROM cp), own AS (SELECT p.*, mate, row_number() OVER (PARTITION BY p.ind ORDER BY req, code) AS r, count(*) OVER (PARTITION BY p.ind) AS n FROM pop p JOIN mate USING (ind) WHERE NOT EXISTS (SELECT 1 FROM pop q WHERE q.ind = mate AND q.req = p.req AND q.code = p.code)), mv AS (SELECT o.ind, o.mate, o.req, o.code FROM own o JOIN (SELECT DISTINCT ind, n FROM own) m ON m.ind = o.mate WHERE r <= least(3, o.n, m.n)) SELECT * FROM pop p WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.ind = p.ind AND mv.req = p.req AND mv.code = p.code) UNION ALL SELECT mate, req, code FROM mv")
def ga03(spark, d):
    o = load(spark, d, "orders").select("o_orderkey")
    couples = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b")).join(o.select(F.col("o_orderkey").alias("b")), "b")
    return evolve.swapped(population(spark, d), couples, 3)


@query("ga04_mutation", f"WITH {_POP}, fr AS (SELECT DISTINCT o_orderkey AS ind, (o_custkey * 7 + k) % 200 + 1 AS req, (o_custkey + k) % 10 + 1 AS code FROM orders, (SELECT unnest(range(3)) AS k)), nw AS (SELECT *, row_number() OVER (PARTITION BY ind ORDER BY req, code) AS r FROM (SELECT * FROM fr EXCEPT SELECT * FROM pop)), n AS (SELECT ind, least(count(*), 2) AS n FROM nw GROUP BY ind), k AS (SELECT pop.*, row_number() OVER (PARTITION BY ind ORDER BY req, code) AS r, count(*) OVER (PARTITION BY ind) AS size FROM pop) SELECT k.ind, req, code FROM k LEFT JOIN n USING (ind) WHERE r > least(coalesce(n, 0), size) UNION ALL SELECT nw.ind, nw.req, nw.code FROM nw JOIN (SELECT DISTINCT ind, size FROM k) USING (ind) WHERE r <= least(2, size)")
def ga04(spark, d):
    k = F.explode(F.array(*(F.lit(i).cast("long") for i in range(3))))
    fresh = load(spark, d, "orders").select(F.col("o_orderkey").alias("ind"), "o_custkey", k.alias("k")).select("ind", ((F.col("o_custkey") * 7 + F.col("k")) % 200 + 1).alias("req"), ((F.col("o_custkey") + F.col("k")) % 10 + 1).alias("code"))
    return evolve.replaced(population(spark, d), fresh, 2)


@query("ga05_tournament", f"WITH {_POINTS} SELECT ind // 4 AS match, arg_min(ind, (ind % 3, -a, ind)) AS ind FROM pt GROUP BY 1")
def ga05(spark, d):
    """Tournaments of neighbouring orders, by front, then crowding."""
    p = points(spark, d)
    return evolve.winners(p.select(F.floor(F.col("ind") / 4).cast("long").alias("match"), "ind"), p.select("ind", (F.col("ind") % 3).alias("front"), F.col("a").alias("crowding")))


@query("ga06_elitism", f"WITH {_POINTS}, o AS (SELECT ind, a AS value FROM pt WHERE ind % 2 = 0), n AS (SELECT ind, a AS value FROM pt WHERE ind % 2 = 1) SELECT 'merge' AS policy, * FROM (SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM n) ORDER BY value DESC, ind LIMIT 50) UNION ALL SELECT 'none', * FROM (SELECT * FROM n ORDER BY value DESC, ind LIMIT 50) UNION ALL SELECT 'first', * FROM (SELECT * FROM o ORDER BY value DESC, ind LIMIT 1) UNION ALL SELECT 'first', * FROM (SELECT * FROM n ORDER BY value DESC, ind LIMIT 49)")
def ga06(spark, d):
    """The next population of fifty by each policy; the old one are the even orders, the new one the odd ones."""
    p = materialize(points(spark, d).select("ind", F.col("a").alias("value")), "points")
    old, new, out = p.filter("ind % 2 = 0"), p.filter("ind % 2 = 1"), None
    for policy in ("merge", "none", "first"):
        one = evolve.elite(old, new, 50, policy).select(F.lit(policy).alias("policy"), "ind", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("ga08_report", "SELECT o_custkey % 20 AS generation, count(*) AS individuals, max(o_totalprice) AS best, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS worst FROM orders GROUP BY 1")
def ga08(spark, d):
    return evolve.report(load(spark, d, "orders").select((F.col("o_custkey") % 20).alias("generation"), F.col("o_totalprice").alias("value"))).withColumn("mean", F.round("mean", 4))


@query("ns01_seed", f"WITH {D.TRACE_SQL} SELECT req, code, round(max(sim) FILTER (WHERE tool = 'tool_a'), 6) AS a, round(max(sim) FILTER (WHERE tool = 'tool_b'), 6) AS b FROM scores WHERE tool IN ('tool_a', 'tool_b') GROUP BY req, code HAVING count(DISTINCT tool) = 2")
def ns01(spark, d):
    """The pairs that two tools score, with a similarity dimension for each."""
    s = D.trace_scores(spark, d).select(F.col("tool").alias("dim"), "req", "code", "sim")
    out = evolve.seed(s, ["tool_a", "tool_b"])
    return out.select("req", "code", F.round("tool_a", 6).alias("a"), F.round("tool_b", 6).alias("b"))


@query("ns06_crowded_order", f"WITH {_POINTS} SELECT ind, row_number() OVER (PARTITION BY ind % 7 ORDER BY ind % 3, a DESC, ind) AS pos FROM pt")
def ns06(spark, d):
    """The crowded order of individuals within groups."""
    p = points(spark, d).select("ind", (F.col("ind") % 7).alias("g"), (F.col("ind") % 3).alias("front"), F.col("a").alias("crowding"))
    w = Window.partitionBy("g").orderBy(*evolve.crowded_order())
    return p.select("ind", F.row_number().over(w).cast("long").alias("pos"))


@query("ns08_search")
def ns08(spark, d):
    """The last population of a search over all pairs that two tools score, with the default settings."""
    s = D.trace_scores(spark, d).filter("tool in ('tool_a', 'tool_b')").groupBy("req", "code").pivot("tool", ["tool_a", "tool_b"]).agg(F.max("sim"))
    found = evolve.search(evolve.TablePool(s, ["tool_a", "tool_b"]), evolve.Settings())
    return spark.createDataFrame([(i, len(p), *map(float, v)) for i, (p, v) in enumerate(found)], "ind int, links int, a double, b double")


@query("ns09_front_evaluation", f"WITH {D.TRACE_SQL}, lk AS (SELECT tool || substr(req, 1, 2) AS ind, req, code, hit FROM hits), v AS (SELECT ind, count(*) AS found, sum(hit)::BIGINT AS hits, count(DISTINCT code) AS codes, count(DISTINCT req) AS reqs FROM lk GROUP BY ind), fr AS (SELECT * FROM v x WHERE NOT EXISTS (SELECT 1 FROM v y WHERE y.codes >= x.codes AND -y.reqs >= -x.reqs AND (y.codes > x.codes OR y.reqs < x.reqs))) SELECT ind, {_PRF} FROM (SELECT *, (SELECT count(*) FROM gold) AS gold FROM fr)")
def ns09(spark, d):
    """The individuals of the first front, here the links of a tool for each kind of requirement, against the gold set."""
    links = D.trace_scores(spark, d).select(F.concat("tool", F.substring("req", 1, 2)).alias("ind"), "req", "code")
    v = links.groupBy("ind").agg(F.countDistinct("code").cast("double").alias("codes"), (-F.countDistinct("req")).cast("double").alias("reqs"))
    front = evolve.first_front(v, ["codes", "reqs"]).select("ind")
    return _rounded(M.evaluate(links.join(front, "ind"), D.trace_gold(spark, d), ("ind",)), "precision", "recall", "f1")


_C = "c AS (SELECT dataset AS box, lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE dataset IS NOT NULL AND req_filename IS NOT NULL AND code_filename IS NOT NULL)"


@query("set06_containers", f"WITH {_C}, m AS (SELECT 'both' AS box, req, code FROM c WHERE box IN ('altavia', 'medorna')), u AS (SELECT DISTINCT * FROM m), r AS (SELECT * FROM u WHERE code NOT LIKE 'db%') SELECT 'with_duplicates' AS policy, count(*) AS n FROM m UNION ALL SELECT 'without', count(*) FROM u UNION ALL SELECT 'removed', count(*) FROM r")
def set06(spark, d):
    """Two containers of pairs merged, with and without duplicates, and pairs removed from the merged one."""
    c = load(spark, d, "trace_link").filter("req_filename is not null and code_filename is not null").select("dataset", F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code"))
    box = lambda x: c.filter(F.col("dataset") == x).select("req", "code")
    both = L.merged(box("altavia"), box("medorna"), duplicates=True)
    single = L.merged(box("altavia"), box("medorna"), duplicates=False)
    rest = L.removed(single, single.filter("code like 'db%'"))
    out = None
    for name, x in (("with_duplicates", both), ("without", single), ("removed", rest)):
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("policy"), "n")
        out = one if out is None else out.unionByName(one)
    return out
