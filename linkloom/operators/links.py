"""From similarities of parts to links of files: thresholds, votes, top-n, neighbours in the call graph, combinations.

A similarity row is (run..., code, elem, req, part, sim); `run` are optional further key columns, such as the
thresholds e and m of a grid. `reverse` means that smaller is more similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.vectors import better, min_max, reduce_by


def finite(df: DataFrame, sim: str = "sim") -> DataFrame:
    """Without null, NaN and infinite similarities, which stand for 'no known word'."""
    return df.filter(F.col(sim).isNotNull() & ~F.isnan(sim) & (F.abs(F.col(sim)) < F.lit(float("inf"))))


def threshold(df: DataFrame, limit: Column, reverse: bool = False, sim: str = "sim") -> DataFrame:
    return df.filter(better(F.col(sim), limit, reverse))


def file_threshold(df: DataFrame, limit: Column, reverse: bool = False, sim: str = "sim") -> DataFrame:
    """Strict, but inclusive where smaller is more similar. Rows without a similarity, added by rules, stay."""
    return df.filter(F.col(sim).isNull() | (F.col(sim) <= limit if reverse else F.col(sim) > limit))


def reduce_requirements(df: DataFrame, how: str = "max", run: tuple[str, ...] = ()) -> DataFrame:
    """One similarity for each code element and requirement."""
    return df.groupBy(*run, "code", "elem", "req").agg(reduce_by(how)("sim").alias("sim"))


def majority(votes: DataFrame, how: str = "max", run: tuple[str, ...] = ()) -> DataFrame:
    """One vote per row (code, req, sim): all requirements tied at most votes of a code file win; a link's similarity is reduced over its votes."""
    count = votes.groupBy(*run, "code", "req").agg(F.count("*").alias("votes"), reduce_by(how)("sim").alias("sim"))
    w = Window.partitionBy(*run, "code")
    return count.withColumn("_m", F.max("votes").over(w)).filter("votes = _m").drop("_m")


def top_n_votes(df: DataFrame, n: Column | int, reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """The n best requirements of each element; equal similarities by requirement."""
    w = Window.partitionBy(*run, "code", "elem").orderBy(F.col("sim").asc() if reverse else F.col("sim").desc(), "req")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def majority_links(sims: DataFrame, e: Column, m: Column, how_req: str = "max", how_code: str = "max", reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """Element threshold, requirement reduction, majority threshold, majority."""
    reduced = reduce_requirements(threshold(finite(sims), e, reverse), how_req, run)
    return majority(threshold(reduced, m, reverse), how_code, run)


def top_n_links(sims: DataFrame, e: Column, n: Column | int, how_req: str = "max", how_code: str = "max", reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    reduced = reduce_requirements(threshold(finite(sims), e, reverse), how_req, run)
    return majority(top_n_votes(reduced, n, reverse, run), how_code, run)


def majority_statistics(links: DataFrame, votes: DataFrame) -> DataFrame:
    """Mean and median number of winners and of candidates of a code file."""
    c = votes.groupBy("code").agg(F.countDistinct("req").alias("candidates"))
    w = links.groupBy("code").agg(F.count("*").alias("winners"))
    return c.join(w, "code").agg(F.avg("winners").alias("mean_winners"), F.median("winners").alias("median_winners"), F.avg("candidates").alias("mean_candidates"), F.median("candidates").alias("median_candidates"))


def normalise(links: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Similarities of a whole run to 0..1; unchanged if all are equal. Two aggregates and a join, so a run without keys isn't put into one task."""
    if run:
        ends = links.groupBy(*run).agg(F.min("sim").alias("_lo"), F.max("sim").alias("_hi"))
        return links.join(ends, list(run)).withColumn("sim", min_max(F.col("sim"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    ends = links.agg(F.min("sim").alias("_lo"), F.max("sim").alias("_hi")).withColumn("_k", F.lit(1))
    return links.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k").withColumn("sim", min_max(F.col("sim"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_k")


def neighbour_rows(reduced: DataFrame, edges: DataFrame, direction: str = "both", run: tuple[str, ...] = ()) -> DataFrame:
    """(run, code, elem, req, sim, near): own similarities (near false) and those of neighbours in the call graph (near true).

    edges are (caller, callee) of elements; 'down' takes the called, 'up' the calling ones. Every edge counts, also repeated ones.
    """
    down = edges.select(F.col("caller").alias("elem"), F.col("callee").alias("other"))
    up = edges.select(F.col("callee").alias("elem"), F.col("caller").alias("other"))
    near = {"down": down, "up": up, "both": down.unionByName(up)}[direction]
    own = reduced.select(*run, "code", "elem", "req", "sim", F.lit(False).alias("near"))
    owners = reduced.select("code", "elem").distinct()
    of_others = reduced.select(*run, F.col("elem").alias("other"), "req", "sim")
    return own.unionByName(near.join(owners, "elem").join(of_others, "other").select(*run, "code", "elem", "req", "sim", F.lit(True).alias("near")))


def double_majority(rows: DataFrame, how: str = "max", reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """Each element votes, with its neighbours, for their best requirement: a majority within the element, then one across elements."""
    best = rows.withColumn("_s", -F.col("sim") if reverse else F.col("sim"))
    voter = best.groupBy(*run, "code", "elem", "near", "req").agg(F.max("_s").alias("_s"))
    inner = voter.groupBy(*run, "code", "elem", "req").agg(F.count("*").alias("votes"), F.max("_s").alias("_s"))
    w = Window.partitionBy(*run, "code", "elem")
    won = inner.withColumn("_m", F.max("votes").over(w)).filter("votes = _m").withColumn("_b", F.max("_s").over(w)).filter("_s = _b")
    return majority(won.select(*run, "code", "req", (-F.col("_s") if reverse else F.col("_s")).alias("sim")), how, run)


def all_call_majority(rows: DataFrame, how: str = "max", run: tuple[str, ...] = ()) -> DataFrame:
    """Every similarity above the threshold, of an element or a neighbour, is a vote."""
    return majority(rows, how, run)


def replicated_votes(rows: DataFrame, weight: float, how: str = "max", run: tuple[str, ...] = ()) -> DataFrame:
    """All-call majority in which an element's own votes weigh `weight` of all: they are counted once more for each of round(weight / (1 - weight) * neighbour votes) - own votes."""
    if not 0 <= weight < 1:
        raise ValueError("the weight lies in [0, 1)")
    w = Window.partitionBy(*run, "code", "elem")
    cnt = rows.withColumn("_c", F.sum(F.when(F.col("near"), 0).otherwise(1)).over(w)).withColumn("_n", F.sum(F.when(F.col("near"), 1).otherwise(0)).over(w))
    factor = 1 + F.greatest(F.lit(0), F.bround(F.lit(weight / (1 - weight)) * F.col("_n"), 0) - F.col("_c"))
    votes = cnt.withColumn("_v", F.when(F.col("near") | (F.col("_n") == 0), F.lit(1.0)).otherwise(factor))
    count = votes.groupBy(*run, "code", "req").agg(F.sum("_v").cast("long").alias("votes"), reduce_by(how)("sim").alias("sim"))
    return count.withColumn("_m", F.max("votes").over(Window.partitionBy(*run, "code"))).filter("votes = _m").drop("_m")


def weighted_sums(rows: DataFrame, weight: float | None, run: tuple[str, ...] = ()) -> DataFrame:
    """For each element and requirement weight * own + (1 - weight) * mean of neighbours; the one there is if the other is missing; own if there is no weight."""
    own, near = F.max(F.when(~F.col("near"), F.col("sim"))), F.avg(F.when(F.col("near"), F.col("sim")))
    g = rows.groupBy(*run, "code", "elem", "req").agg(own.alias("_o"), near.alias("_n"))
    both = F.col("_o") if weight is None else weight * F.col("_o") + (1 - weight) * F.col("_n")
    return g.select(*run, "code", "elem", "req", F.when(F.col("_o").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_o")).otherwise(both).alias("sim"))


def weighted_sum_links(sims: DataFrame, edges: DataFrame, weight: float | None, e: Column, m: Column, direction: str = "both", how_req: str = "max", how_code: str = "max", reverse: bool = False, run: tuple[str, ...] = ()) -> DataFrame:
    """Element threshold and reduction, weighted sums with neighbours, majority threshold, majority."""
    reduced = reduce_requirements(threshold(finite(sims), e, reverse), how_req, run)
    sums = weighted_sums(neighbour_rows(reduced, edges, direction, run), weight, run)
    return majority(threshold(sums, m, reverse), how_code, run)


def separate_majorities(a: DataFrame, b: DataFrame, reverse: bool = False) -> DataFrame:
    """Links of two sources, the better similarity of each (code, req)."""
    both = a.select("code", "req", "sim").unionByName(b.select("code", "req", "sim"))
    return both.groupBy("code", "req").agg((F.min if reverse else F.max)("sim").alias("sim"))


def union_majority(a: DataFrame, b: DataFrame, how: str = "max") -> DataFrame:
    """A majority over the votes of both sources."""
    return majority(a.select("code", "req", "sim").unionByName(b.select("code", "req", "sim")), how)


def return_all(a: DataFrame, b: DataFrame, how: str = "max", reverse: bool = False) -> DataFrame:
    """No majority: every voted requirement of either source, reduced per source, the better one kept."""
    per = lambda x: x.groupBy("code", "req").agg(reduce_by(how)("sim").alias("sim"))
    return separate_majorities(per(a), per(b), reverse)


def rule_links(links: DataFrame, relation: DataFrame, direction: str = "up") -> DataFrame:
    """links plus, for every link to a code file, links without similarity to its relatives in relation (sub, super); not transitive, duplicates kept."""
    up = relation.select(F.col("sub").alias("code"), F.col("super").alias("_o"))
    down = relation.select(F.col("super").alias("code"), F.col("sub").alias("_o"))
    rel = {"up": up, "down": down, "both": up.unionByName(down)}[direction]
    new = links.join(rel, "code").select(F.col("_o").alias("code"), "req", F.lit(None).cast("double").alias("sim"))
    return links.select("code", "req", "sim").unionByName(new)


def merged(a: DataFrame, b: DataFrame, duplicates: bool = False) -> DataFrame:
    """The pairs of two containers; a pair in both counts once unless duplicates are wanted."""
    both = a.select("req", "code").unionByName(b.select("req", "code"))
    return both if duplicates else both.distinct()


def removed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Container a without the pairs of b, however often they are in a."""
    return a.join(b.select("req", "code").distinct(), ["req", "code"], "left_anti")


def same_class(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (caller, callee) between elements of one class, from classes (elem, owner); owner is the class name, or the file where a language has no classes."""
    c = classes.select(F.col("elem").alias("caller"), F.col("owner").alias("_a"))
    e = classes.select(F.col("elem").alias("callee"), F.col("owner").alias("_b"))
    return edges.join(c, "caller").join(e, "callee").filter("_a = _b").select("caller", "callee")
