"""Evaluation of links against a gold set: precision, recall, F1, average precision, MAP, curves and best cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.similarity import blocks
from linkloom.runtime import materialize, spread


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def with_hits(links: DataFrame, gold: DataFrame) -> DataFrame:
    """links with hit, 1 for those in the gold set, compared without regard to case."""
    g = gold.select(F.lower("req").alias("_r"), F.lower("code").alias("_c"), F.lit(1).alias("hit")).distinct()
    return links.join(g, (F.lower(links["req"]) == F.col("_r")) & (F.lower(links["code"]) == F.col("_c")), "left").drop("_r", "_c").withColumn("hit", F.coalesce("hit", F.lit(0)))


def precision_recall(found: Column, hits: Column, gold: Column) -> list[Column]:
    p, r = ratio(hits, found), ratio(hits, gold)
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def evaluate(links: DataFrame, gold: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """One row per run: found links, repeated ones included, distinct hits, gold links and the metrics."""
    hits = with_hits(links, gold)
    pair = F.struct(F.lower("req"), F.lower("code"))
    # distinct hits in two plain aggregates rather than a distinct over expanded rows
    each = hits.groupBy(*run, pair.alias("_p")).agg(F.count("*").alias("_n"), F.max("hit").alias("_h"))
    cell = each.groupBy(*run).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("found"), F.coalesce(F.sum("_h"), F.lit(0)).cast("long").alias("hits")).withColumn("_k", F.lit(1))
    size = gold.select(F.lower("req"), F.lower("code")).distinct().agg(F.count("*").alias("gold")).withColumn("_k", F.lit(1))
    return cell.join(F.broadcast(size), "_k").select(*run, "found", "hits", "gold", *precision_recall(F.col("found"), F.col("hits"), F.col("gold")))


def evaluate_tuples(tuples: DataFrame, gold: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """evaluate() of a set of tuples `link` (req, code); a tuple counts once."""
    return evaluate(tuples.select(*run, "link").distinct().select(*run, "link.req", "link.code"), gold, run)


def ranked(links: DataFrame, by: tuple[str, ...], reverse: bool = False) -> DataFrame:
    """Links with rank, running hits and precision@k within `by`; equal similarities by code, then requirement."""
    w = Window.partitionBy(*by).orderBy(F.col("sim").asc() if reverse else F.col("sim").desc(), "code", "req")
    out = links.withColumn("rank", F.row_number().over(w)).withColumn("hits_so_far", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("precision_at", F.col("hits_so_far") / F.col("rank"))


def average_precision(links: DataFrame, by: tuple[str, ...], reverse: bool = False, k: int | None = None) -> DataFrame:
    """Average precision of each ranking over its first k links: the mean of precision at hits; 0 without a hit."""
    r = ranked(links, by, reverse)
    r = r if k is None else r.filter(F.col("rank") <= k)
    s = F.sum("hit")
    return r.groupBy(*by).agg(F.when(s == 0, F.lit(0.0)).otherwise(F.sum(F.col("precision_at") * F.col("hit")) / s).alias("ap"), s.cast("long").alias("hits"))


def complete(links: DataFrame, reqs: DataFrame, codes: DataFrame, reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """links with a link of the worst similarity for every missing pair; the pairs wanted are all of the two lists, within a run.

    The code files go to all executors in blocks of bounded size, the requirements stay in place. Each requirement
    brings the code files it has a link to, so no pair is shuffled.
    """
    keys, pairs = [*run, "req"], None
    own = links.groupBy(*keys).agg(F.collect_set("code").alias("_own"))
    left = spread(materialize(reqs.select(*keys).distinct().join(own, keys, "left"), "requirements"))
    for block in blocks(materialize(codes.select(*run, "code").distinct(), "code-files"), "code"):
        part = left.join(F.broadcast(block), list(run)) if run else left.join(F.broadcast(block))
        pairs = part if pairs is None else pairs.unionByName(part)
    linked = F.coalesce(F.array_contains("_own", F.col("code")), F.lit(False))
    missing = pairs.filter(~linked).withColumn("sim", F.lit(1.0 if reverse else 0.0))
    return links.select(*run, "req", "code", "sim").unionByName(missing.select(*run, "req", "code", "sim"))


def map_at_k(links: DataFrame, n_reqs: int, k: int, reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """The sum of average precisions over the first k links of each requirement, divided by the number of requirements, by run."""
    return average_precision(links, (*run, "req"), reverse, k).groupBy(*run).agg((F.sum("ap") / n_reqs).alias("map")).withColumn("k", F.lit(k).cast("long"))


def map_and_recall(links: DataFrame, n_reqs: int, n_gold: int, n_codes: int, reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """(run, k, map, recall) for every k from 1 to n_codes, from one ranking: the average precision at k comes from running sums.

    Both stay as they are beyond the longest ranking of all, so rankings are only followed to there.
    """
    r = ranked(links, (*run, "req"), reverse)
    longest = min(r.agg(F.max("rank")).first()[0] or 0, n_codes)
    w = Window.partitionBy(*run, "req").orderBy("rank")
    at = r.withColumn("_s", F.sum(F.col("precision_at") * F.col("hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("ap", F.when(F.col("hits_so_far") == 0, 0.0).otherwise(F.col("_s") / F.col("hits_so_far")))
    # a requirement with fewer links keeps its last value for all larger k
    nxt = at.withColumn("_to", F.coalesce(F.lead("rank").over(w) - 1, F.lit(longest)))
    rows = nxt.filter(F.col("rank") <= longest).select(*run, F.explode(F.sequence(F.col("rank"), F.greatest("rank", "_to"))).alias("k"), "ap", "hits_so_far")
    out = rows.groupBy(*run, F.col("k").cast("long").alias("k")).agg((F.sum("ap") / n_reqs).alias("map"), (F.sum("hits_so_far") / n_gold).alias("recall"))
    if longest >= n_codes:
        return out
    rest = links.sparkSession.range(longest + 1, n_codes + 1).select(F.col("id").alias("k"))
    return out.unionByName(rest.join(F.broadcast(out.filter(F.col("k") == longest).select(*run, "map", "recall"))).select(*run, "k", "map", "recall"))


def integral_average_precision(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The discrete integral of precision over recall. A curve has few points, one for each distinct recall."""
    w = Window.partitionBy(*by).orderBy("recall")
    steps = curve.withColumn("_d", F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0)))
    return steps.groupBy(*by).agg(F.sum(F.col("_d") * F.col("precision")).alias("ap"))


def curve(cells: DataFrame, by: tuple[str, ...] = (), rule: str = "max", order: Column | None = None) -> DataFrame:
    """One precision per recall: the largest, or with rule 'last' the one written last in `order`."""
    g = cells.groupBy(*by, "recall")
    return g.agg(F.max("precision").alias("precision") if rule == "max" else F.max_by("precision", order).alias("precision"))


def best_cell(cells: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The cell of the largest F1, the first in order of equal ones."""
    key = F.struct(F.col("f1"), *[(-F.col(c)).alias(c) for c in order])
    cols = [c for c in cells.columns if c not in by]
    return cells.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("_c")).select(*by, "_c.*")


def best_config(cells: DataFrame, config: list[str], n_datasets: int) -> DataFrame:
    """Mean F1 by configuration over all datasets; configurations missing in one are left out."""
    return cells.groupBy(*config).agg(F.avg("f1").alias("mean_f1"), F.countDistinct("dataset").alias("_n")).filter(F.col("_n") == n_datasets).drop("_n")


def best_technique(cells: DataFrame) -> DataFrame:
    """The best F1 of each technique in each dataset, averaged over datasets."""
    return cells.groupBy("technique", "dataset").agg(F.max("f1").alias("f1")).groupBy("technique").agg(F.avg("f1").alias("mean_best_f1"))


def gold_statistics(gold: DataFrame) -> DataFrame:
    return gold.agg(F.count("*").alias("links"), F.countDistinct("req").alias("reqs"), F.countDistinct("code").alias("codes"))
