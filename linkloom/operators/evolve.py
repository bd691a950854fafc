"""Evolutionary search for link sets: fitness, fronts and crowding as tables; the generation loop on the driver.

A population is small by its parameters (population size times genes), whatever the size of the candidates.
"""

from __future__ import annotations

import itertools
import random
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.runtime import materialize

Gene = tuple[str, str]


def fitness(individuals: DataFrame, sims: DataFrame, unique: bool = False, how: str = "avg") -> DataFrame:
    """(ind, dim, value): average or sum of the similarities of an individual's links (ind, req, code) in each dimension of sims (dim, req, code, sim)."""
    links = individuals.select("ind", "req", "code")
    j = (links.distinct() if unique else links).join(sims, ["req", "code"])
    return j.groupBy("ind", "dim").agg((F.avg if how == "avg" else F.sum)("sim").alias("value"))


def without_twins(individuals: DataFrame) -> DataFrame:
    """Of individuals with the same set of links the one of the smallest number."""
    key = individuals.groupBy("ind").agg(F.sort_array(F.collect_set(F.struct("req", "code"))).alias("_s"))
    return individuals.join(key.groupBy(F.xxhash64("_s").alias("_h"), "_s").agg(F.min("ind").alias("ind")).select("ind"), "ind", "left_semi")


def first_front(points: DataFrame, dims: list[str], key: str = "ind") -> DataFrame:
    """Points that no other dominates (at least as large in all dimensions, larger in one).

    In each round the skyline of blocks of points is taken first; a point that is dominated within its block
    can't be in the front, so only block winners meet in the final comparison.
    """
    def undominated(df: DataFrame, on: list[str]) -> DataFrame:
        other = df.select(*on, *(F.col(d).alias(f"__{d}") for d in dims)).distinct()
        ge, gt = F.lit(True), F.lit(False)
        for d in dims:
            ge, gt = ge & (F.col(f"__{d}") >= F.col(d)), gt | (F.col(f"__{d}") > F.col(d))
        joined = df.alias("l").join(other.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [ge & gt], "left_anti")
        return joined.select(df.columns)

    local = undominated(points.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(64))), ["block_"])
    return undominated(local.withColumn("block_", F.lit(0)), ["block_"]).drop("block_")


def _distinct_points(points: DataFrame, dims: list[str]) -> DataFrame:
    return materialize(points.filter(" and ".join(f"{d} is not null" for d in dims)).groupBy(*dims).agg(F.count("*").alias("n")), "points")


def _pairs_in_order(y: np.ndarray, n: np.ndarray) -> int:
    """The sum of n[i] * n[j] over i < j with y[i] >= y[j], by merging runs of doubling length."""
    total, at, width = 0, np.arange(len(y)), 1
    while width < len(y):
        block, right = at // (2 * width), (at // width) & 1
        order = np.lexsort((right, -y, block))  # of equal values the left ones first
        left = np.where(right[order] == 0, n[order], 0)
        before = np.cumsum(left)
        start = np.searchsorted(block[order], np.arange(block[-1] + 1))
        before -= np.append(0, before)[start][block[order]]
        total += int((before * n[order])[right[order] == 1].sum())
        width *= 2
    return total


def dominations(points: DataFrame, x: str, y: str, block_points: int = 50_000, most_blocks: int = 1024) -> DataFrame:
    """(pairs): the number of pairs of points of which the first dominates the second in x and y, exactly.

    Equal points are counted together. Points are cut into blocks by x and by y. Of two points that differ in both
    blocks, the counts of the blocks tell; those of one block of x, and those of one block of y in different blocks
    of x, are counted within that block, one block to a task. The driver holds the counts of the blocks only.
    """
    rows = _distinct_points(points, [x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "n")
    k = max(1, min(most_blocks, -(-rows.count() // block_points)))
    share = [i / k for i in range(1, k)]
    cuts = [sorted(set(c)) for c in rows.approxQuantile(["x", "y"], share, 1 / (4 * k))] if k > 1 else [[], []]

    def block(c: str, ends: list[float]):
        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(ends, v, side="right").astype("int32"))

        return place(c)

    placed = materialize(rows.withColumn("bx", block("x", cuts[0])).withColumn("by", block("y", cuts[1])), "placed")
    grid = np.zeros((len(cuts[0]) + 1, len(cuts[1]) + 1), object)
    for bx, by, n in placed.groupBy("bx", "by").agg(F.sum("n")).collect():
        grid[bx, by] = n
    above = np.cumsum(np.cumsum(grid[::-1, ::-1], 0), 1)[::-1, ::-1]
    apart = sum(grid[i, j] * above[i + 1, j + 1] for i in range(grid.shape[0] - 1) for j in range(grid.shape[1] - 1))

    def within_x(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["x", "y"], ascending=[False, False])
        return pd.DataFrame({"pairs": [_pairs_in_order(p["y"].to_numpy(), p["n"].to_numpy())]})

    def within_y(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["bx", "y"], ascending=[False, True])  # a block of x in rising order of y, so that only equal values of y count
        same = p.groupby(["bx", "y"])["n"].agg([lambda v: int(v.sum()) ** 2, lambda v: int((v**2).sum())])
        return pd.DataFrame({"pairs": [_pairs_in_order(p["y"].to_numpy(), p["n"].to_numpy()) - int((same.iloc[:, 0] - same.iloc[:, 1]).sum()) // 2]})

    parts = placed.groupBy("bx").applyInPandas(within_x, "pairs long").unionByName(placed.groupBy("by").applyInPandas(within_y, "pairs long"))
    return parts.agg((F.coalesce(F.sum("pairs"), F.lit(0)) + F.lit(int(apart))).cast("long").alias("pairs"))


def fronts_of_two(points: DataFrame, x: str, y: str, block_points: int = 1_000_000) -> DataFrame:
    """points with `front` in the dimensions x and y, all fronts in one pass over the distinct points.

    In falling order of x, then y, a point belongs to the first front whose smallest y so far is smaller than its own:
    a front's last point in this order has its smallest y, and if that is at least as large, it dominates the point.
    The points are taken in blocks of falling x, one after the other, each by one task; from block to block go only
    the smallest y of the fronts. Points without a value have no front.
    """
    rows = _distinct_points(points, [x, y]).select(x, y)
    k = -(-rows.count() // block_points)
    cuts = sorted(set(rows.select(F.col(x).cast("double").alias("x")).approxQuantile("x", [i / k for i in range(1, k)], 1 / (4 * k)))) if k > 1 else []
    ends: list[float] = []
    schema, done = f"{x} {rows.schema[x].dataType.simpleString()}, {y} {rows.schema[y].dataType.simpleString()}, front int", None
    for lo, hi in zip([*reversed(cuts), None], [None, *reversed(cuts)], strict=True):
        part = rows.filter((F.lit(True) if lo is None else F.col(x) >= lo) & (F.lit(True) if hi is None else F.col(x) < hi))

        def number(batches: Iterator[pd.DataFrame], low: tuple[float, ...] = tuple(ends)) -> Iterator[pd.DataFrame]:
            got, low = list(batches), list(low)
            if not got:
                return
            p = pd.concat(got).sort_values([x, y], ascending=[False, False])
            front = np.empty(len(p), np.int32)
            for i, v in enumerate(p[y].tolist()):
                j = bisect_left(low, True, key=lambda w: w < v)
                low[j : j + 1] = [v]
                front[i] = j + 1
            yield p.assign(front=front)

        found = materialize(part.repartition(1).mapInPandas(number, schema), "fronts")
        done = found if done is None else done.unionByName(found)
        for front, v in found.groupBy("front").agg(F.min(y)).orderBy("front").collect():
            ends[front - 1 : front] = [v]
    return points.join(done, [x, y], "left").select(*points.columns, "front")


def fronts(points: DataFrame, dims: list[str], key: str = "ind", most: int | None = None) -> DataFrame:
    """points with `front`, peeled one front after the other until nothing is left, or `most` fronts."""
    left, out = points, None
    for k in itertools.count(1) if most is None else range(1, most + 1):
        front = materialize(first_front(left, dims, key).withColumn("front", F.lit(k)), "front")
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
        left = left.join(front.select(key), key, "left_anti")
    return out if out is not None else points.withColumn("front", F.lit(None).cast("int")).limit(0)


def crowding(points: DataFrame, dims: list[str], key: str = "ind") -> DataFrame:
    """(key, front, crowding): the gaps between the neighbours in each dimension of a front, over the number of dimensions times the range; ends are infinite, a dimension without range adds nothing."""
    long = points.select(key, "front", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("v")) for d in dims))).alias("x")).select(key, "front", "x.dim", "x.v")
    w, all_ = Window.partitionBy("front", "dim").orderBy("v", key), Window.partitionBy("front", "dim")
    span = F.max("v").over(all_) - F.min("v").over(all_)
    ends = F.lag("v").over(w).isNull() | F.lead("v").over(w).isNull()
    gap = F.when(span == 0, 0.0).when(ends, F.lit(float("inf"))).otherwise((F.lead("v").over(w) - F.lag("v").over(w)) / (len(dims) * F.when(span == 0, 1.0).otherwise(span)))
    return long.withColumn("_g", gap).groupBy(key, "front").agg(F.sum("_g").alias("crowding"))


def survivors(ranked: DataFrame, n: int, key: str = "ind") -> DataFrame:
    """The n best by front, then by crowding; ties by key."""
    return ranked.orderBy("front", F.col("crowding").desc(), key).limit(n)


def seed(sims: DataFrame, dims: list[str]) -> DataFrame:
    """(req, code, dims...): the pairs of sims (dim, req, code, sim) that have a similarity in all dimensions."""
    wide = sims.filter(F.col("dim").isin(dims)).groupBy("req", "code").pivot("dim", dims).agg(F.max("sim"))
    return wide.dropna(subset=dims)


def numbered(rows: DataFrame, order: list[str], name: str = "at") -> DataFrame:
    """rows with the numbers 1, 2, ... in the order of the columns: ranges are sorted in parallel and their sizes added up."""
    part = materialize(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in part.groupBy("_p").count().collect()):
        before.append((p, total))
        total += n
    start = F.broadcast(rows.sparkSession.createDataFrame(before, "_p int, _b long"))
    return part.join(start, "_p").withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).select(*rows.columns, name)


def crowded_order() -> list:
    """The order of individuals (ind, front, crowding) in a tournament: lower front, then larger crowding, then number."""
    return [F.col("front"), F.col("crowding").desc(), F.col("ind")]


def trimmed(population: DataFrame, pool: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ind, req, code): individuals of the sizes wanted (ind, size), cut or filled with links of the pool (at, req, code) they lack, in the order of `at` = 1, 2, ...

    The first `size` links of the pool hold enough that an individual lacks. One without links is filled from the
    pool alone; where the pool is too small it stays smaller. Links that are not in the pool are cut first.
    """
    have = population.select("ind", "req", "code").distinct().join(pool.select("req", "code", "at"), ["req", "code"], "left").withColumn("new", F.lit(0))
    offer = sizes.filter("size > 0").select("ind", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size").cast("long"))).alias("at")).join(pool.select("at", "req", "code"), "at")
    lack = offer.join(have.select("ind", "req", "code"), ["ind", "req", "code"], "left_anti").withColumn("new", F.lit(1))
    w = Window.partitionBy("ind").orderBy("new", F.col("at").asc_nulls_last(), "req", "code")
    rows = have.unionByName(lack.select(*have.columns)).withColumn("_r", F.row_number().over(w))
    return rows.join(sizes.select("ind", "size"), "ind").filter("_r <= size").select("ind", "req", "code")


def swapped(population: DataFrame, couples: DataFrame, most: int) -> DataFrame:
    """(ind, req, code): the population after couples (a, b) swapped up to `most` links that the other doesn't have, in the order of the links.

    Each individual is in one couple at most; sizes stay.
    """
    links = population.select("ind", "req", "code").distinct()
    mate = couples.select(F.col("a").alias("ind"), F.col("b").alias("mate")).unionByName(couples.select(F.col("b").alias("ind"), F.col("a").alias("mate")))
    own = links.join(mate, "ind").join(links.select(F.col("ind").alias("mate"), "req", "code"), ["mate", "req", "code"], "left_anti")
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy("ind").orderBy("req", "code"))).withColumn("_n", F.count("*").over(Window.partitionBy("ind")))
    counts = ranked.select(F.col("ind").alias("mate"), F.col("_n").alias("_m")).distinct()
    moving = ranked.join(counts, "mate").filter(F.col("_r") <= F.least(F.lit(most), "_n", "_m"))
    stay = links.join(moving.select("ind", "req", "code"), ["ind", "req", "code"], "left_anti")
    return stay.unionByName(moving.select(F.col("mate").alias("ind"), "req", "code"))


def replaced(population: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """(ind, req, code): the first `most` links of each individual replaced by as many links of fresh (ind, req, code) that it lacks; sizes stay."""
    links = population.select("ind", "req", "code").distinct()
    rank = lambda df, c: df.withColumn(c, F.row_number().over(Window.partitionBy("ind").orderBy("req", "code")))
    new = rank(fresh.select("ind", "req", "code").distinct().join(links, ["ind", "req", "code"], "left_anti"), "_r").filter(F.col("_r") <= most)
    n = new.groupBy("ind").agg(F.count("*").alias("_n"))
    kept = rank(links, "_r").join(n, "ind", "left").withColumn("_size", F.count("*").over(Window.partitionBy("ind")))
    stay = kept.filter(F.col("_r") > F.least(F.coalesce("_n", F.lit(0)), "_size")).select("ind", "req", "code")
    room = kept.select("ind", "_size").distinct()
    return stay.unionByName(new.join(room, "ind").filter(F.col("_r") <= F.col("_size")).select("ind", "req", "code"))


def winners(matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """(match, ind): of the individuals of a match (match, ind) the best by front, then crowding (ind, front, crowding); of equal ones the smallest."""
    key = F.struct("front", (-F.col("crowding")).alias("c"), "ind")
    return matches.join(ranked, "ind").groupBy("match").agg(F.min_by("ind", key).alias("ind"))


def elite(old: DataFrame, new: DataFrame, n: int, policy: str = "merge") -> DataFrame:
    """(ind, value): the next population of n from two of (ind, value): the new one ('none'), with the old one's best in place of its worst ('first'), or the best of both ('merge')."""
    best = lambda df, k: df.orderBy(F.col("value").desc(), "ind").limit(k)
    if policy == "none":
        return best(new, n)
    if policy == "first":
        return best(old, 1).unionByName(best(new, n - 1))
    return best(old.unionByName(new), n)


def report(population: DataFrame, by: str = "generation") -> DataFrame:
    """One row per generation: number of individuals, best, mean and worst value."""
    return population.groupBy(by).agg(F.count("*").alias("individuals"), F.max("value").alias("best"), F.avg("value").alias("mean"), F.min("value").alias("worst"))


@dataclass
class Settings:
    size: int = 60
    genes: int = 40
    generations: int = 20
    crossover: float = 0.8
    mutation: float = 0.5
    max_crossover: int = 10
    max_mutation: int = 10
    elitism: str = "merge"
    seed: int = 43


def crossover(a: frozenset[Gene], b: frozenset[Gene], rng: random.Random, most: int) -> tuple[frozenset[Gene], frozenset[Gene]]:
    """Swaps up to `most` links that the other doesn't have; sizes stay."""
    only_a, only_b = sorted(a - b), sorted(b - a)
    k = min(len(only_a), len(only_b), most)
    if k:
        k = rng.randint(1, k)
        x, y = frozenset(rng.sample(only_a, k)), frozenset(rng.sample(only_b, k))
        a, b = a - x | y, b - y | x
    return a, b


def mutate(a: frozenset[Gene], pool: list[Gene], rng: random.Random, most: int) -> frozenset[Gene]:
    """Replaces up to `most` links by others of the pool; the size stays."""
    free = [g for g in pool if g not in a]
    k = min(len(a), len(free), rng.randint(1, most))
    return a - frozenset(rng.sample(sorted(a), k)) | frozenset(rng.sample(free, k)) if k else a


class Pool:
    """Links with their values in memory."""

    def __init__(self, sims: dict[Gene, tuple[float, ...]]):
        self.values, self.genes = sims, sorted(sims)

    def __len__(self) -> int:
        return len(self.genes)

    def draw(self, n: int, rng: random.Random) -> list[Gene]:
        return rng.sample(self.genes, min(n, len(self.genes)))


class TablePool:
    """All links of a table (req, code, values...) of any size: numbered once, and looked up by number as they are drawn.

    Only links that were drawn come to the driver.
    """

    def __init__(self, table: DataFrame, dims: list[str]):
        h = table.select("req", "code", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in dims)).withColumn("_b", F.pmod(F.xxhash64("req", "code"), F.lit(4096)))
        sizes = {r[0]: r[1] for r in h.groupBy("_b").count().collect()}
        before = dict(zip(sorted(sizes), itertools.accumulate([0, *(sizes[b] for b in sorted(sizes))]), strict=False))
        start = F.broadcast(table.sparkSession.createDataFrame(list(before.items()), "_b long, _before long"))
        numbered = h.join(start, "_b").withColumn("i", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("req", "code")) - 1)
        self.table, self.dims, self.size, self.values = materialize(numbered.select("i", "req", "code", *dims), "pool"), dims, sum(sizes.values()), {}

    def __len__(self) -> int:
        return self.size

    def draw(self, n: int, rng: random.Random) -> list[Gene]:
        wanted = rng.sample(range(self.size), min(n, self.size))
        rows = {r["i"]: r for r in self.table.filter(F.col("i").isin(wanted)).collect()} if wanted else {}
        self.values |= {(r["req"], r["code"]): tuple(r[c] for c in self.dims) for r in rows.values()}
        return [(rows[i]["req"], rows[i]["code"]) for i in wanted]


def tournament(population: list[frozenset[Gene]], better: Callable[[frozenset[Gene], frozenset[Gene]], bool], rng: random.Random) -> frozenset[Gene]:
    a, b = rng.sample(population, 2) if len(population) > 1 else (population[0], population[0])
    return a if better(a, b) else b


def _dominates(x: tuple[float, ...], y: tuple[float, ...]) -> bool:
    return all(p >= q for p, q in zip(x, y, strict=True)) and x != y


def _rank(pop: list[frozenset[Gene]], value: Callable) -> dict[frozenset[Gene], tuple[int, float]]:
    v = {p: value(p) for p in pop}
    out, left, k = {}, list(dict.fromkeys(pop)), 1
    while left:
        front = [p for p in left if not any(_dominates(v[q], v[p]) for q in left)]
        dist = dict.fromkeys(front, 0.0)
        for d in range(len(v[front[0]])):
            order = sorted(front, key=lambda p: (v[p][d], sorted(p)[:1]))
            span = v[order[-1]][d] - v[order[0]][d]
            if span:
                dist[order[0]] = dist[order[-1]] = float("inf")
                for i in range(1, len(order) - 1):
                    dist[order[i]] += (v[order[i + 1]][d] - v[order[i - 1]][d]) / (len(v[front[0]]) * span)
        out |= {p: (k, -dist[p]) for p in front}
        left = [p for p in left if p not in dist]
        k += 1
    return out


def search(sims: dict[Gene, tuple[float, ...]] | Pool | TablePool, settings: Settings) -> list[tuple[frozenset[Gene], tuple[float, ...]]]:
    """The last population with its values, best first: by mean similarity if there is one dimension, by fronts and crowding if there are several. Repeatable for a seed.

    Links are drawn from the whole pool, for the first population and for the mutations of each generation.
    """
    rng, pool = random.Random(settings.seed), Pool(sims) if isinstance(sims, dict) else sims
    if not len(pool):
        return []
    n = min(settings.genes, len(pool))
    drawn = pool.draw(n * settings.size, rng)
    pop = [frozenset(drawn[i * n : (i + 1) * n]) if (i + 1) * n <= len(drawn) else frozenset(rng.sample(drawn, n)) for i in range(settings.size)]
    dims = len(pool.values[drawn[0]])
    value = lambda p: tuple(sum(pool.values[g][d] for g in p) / len(p) for d in range(dims))
    for _ in range(settings.generations):
        rank = _rank(pop, value)
        fitter = lambda a, b: rank[a] <= rank[b]  # noqa: B023, E731
        children: list[frozenset[Gene]] = []
        fresh = pool.draw(settings.size * settings.max_mutation, rng)
        while len(children) < settings.size:
            a, b = tournament(pop, fitter, rng), tournament(pop, fitter, rng)
            if rng.random() < settings.crossover:
                a, b = crossover(a, b, rng, settings.max_crossover)
            children += [mutate(x, fresh, rng, settings.max_mutation) if rng.random() < settings.mutation else x for x in (a, b)]
        if settings.elitism == "none":
            pop = children[: settings.size]
        elif settings.elitism == "first":
            pop = [min(pop, key=lambda p: rank[p]), *children[: settings.size - 1]]
        else:
            both = list(dict.fromkeys(pop + children))
            rank = _rank(both, value)
            pop = sorted(both, key=lambda p: (rank[p], sorted(p)))[: settings.size]
    rank = _rank(pop, value)
    return [(p, value(p)) for p in sorted(dict.fromkeys(pop), key=lambda p: (rank[p], sorted(p)))]
