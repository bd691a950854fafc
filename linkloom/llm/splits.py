"""Splits that keep related records together.

Records that agree in a name (author, source document, entity) are tied. Components of tied records are found by
hooking and shortcutting over parent arrays held in tables: every node hooks to its smallest neighbour, shortcuts
shorten the hook chains, edges are rewritten to the parents and the loop repeats on what is left.
Which components go to which split is chosen on the component sizes alone: subset-sum bitsets over the sizes and
their multiplicities give the reachable totals, and the ones closest to the wanted proportions are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.skew import hot_join
from linkloom.runtime import Table, materialize, write_table

# Names that stand for no name.
PLACEHOLDERS = ["", "unknown", "n/a", "tbd", "-"]
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Bits of the bitsets that the choice of groups keeps at a level of its walk back, 64 MB; only memory and time depend on it.
WINDOW = 1 << 29
_BLANK = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, _BLANK, ""))


def _name(raw: Column, cut: Column) -> Column:
    cut = F.regexp_replace(cut, _BLANK, "")
    return F.when(~raw.isin(PLACEHOLDERS) & ~cut.isin(PLACEHOLDERS), cut)


def author_key(c: Column) -> Column:
    raw = trimmed(c)
    return _name(raw, F.substring_index(raw, "@", 1))


def source_key(c: Column) -> Column:
    raw = trimmed(c)
    return _name(raw, F.regexp_replace(F.regexp_replace(raw, r"(?s)^.*[/\\]", ""), r"\.[^.]*$", ""))


def entity_key(c: Column) -> Column:
    raw = trimmed(c)
    return _name(raw, F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))


def file_key(c: Column) -> Column:
    """A file name trimmed, lower-cased, without folder and .txt; null for null and blank ones."""
    name = F.regexp_replace(F.regexp_replace(trimmed(c), r"(?s)^.*[/\\]", ""), r"\.txt$", "")
    name = F.regexp_replace(name, _BLANK, "")
    return F.when(name != "", name)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component. Rows with a null are left out.

    Rounds go on until no edge is left. Every table is written, and dropped when it is no longer needed. Each join
    has one row per node on its right side and is written at once, so that adaptive execution can split the rows of
    a node in which many meet.
    """
    spark = edges.sparkSession
    edges = edges.filter("a <> b")
    work = write_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", "true")
    rounds: list[Table] = []
    up = lambda h: h.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    while work.counted:
        both = work.df.union(work.df.select("b", "a"))
        hooks = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent")), "hooks")
        # shortcut two steps, twice; chains that are longer still go on in the next round, as every edge is rewritten
        # and a component's smallest node always keeps its own name
        once = hooks.df.join(up(hooks.df), "parent").select("node", F.col("up").alias("parent"))
        rounds.append(write_table(once.join(up(once), "parent").select("node", F.col("up").alias("parent")), "hooks"))
        hooks.drop()
        m = rounds[-1].df
        to = lambda c: m.select(F.col("node").alias(c), F.col("parent").alias(f"r{c}"))  # noqa: B023, E731
        rest = work.df.join(to("a"), "a").join(to("b"), "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = write_table(rest, "edges", "true")
        work.drop()
        work = nxt
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    # every node is in the first round; what it hooked to there may have hooked on in the next ones
    found = rounds[0].df.withColumnRenamed("parent", "root")
    for r in rounds[1:]:
        found = found.join(r.df.select(F.col("node").alias("root"), F.col("parent").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return found


def related_groups(records: DataFrame) -> DataFrame:
    """(req_id, group_id) for every distinct record; group_id is the smallest req_id of its group, itself for a record tied to none.

    Null, blank and placeholder names tie nothing. A record delivered again counts once, rows with a null req_id
    are left out, an empty table gives an empty result, other columns are not read.
    """
    src = records.select(F.col("req_id").cast("long"), author_key(F.col("author")).alias("author"), source_key(F.col("source_doc")).alias("source"), entity_key(F.col("entity")).alias("entity"))
    src = src.filter("req_id is not null")
    flat = src.select("req_id", F.explode(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), c)) for c in ("author", "source", "entity")))).alias("key"))
    rows = materialize(flat.filter("key is not null").select("req_id", F.xxhash64("key").alias("key"), F.xxhash64(F.reverse("key")).alias("check")).distinct(), "keys")
    # two 64-bit hashes stand for the name
    keyed = rows.select("req_id", F.struct("key", "check").alias("key"))
    hubs = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("req_id").alias("hub")).filter("n > 1"), "hubs")
    total = rows.count()
    edges = hot_join(keyed, hubs, "key", "n", total).select(F.col("req_id").alias("a"), F.col("hub").alias("b"))
    roots = components(edges)
    return src.select("req_id").distinct().join(roots, F.col("req_id") == F.col("node"), "left").select("req_id", F.coalesce("root", "req_id").alias("group_id"))


def listed(records: DataFrame, lists: DataFrame) -> DataFrame:
    """(req_id, chosen, remaining) of the records whose file stands on a list, whatever the spelling."""
    files = records.select(F.col("req_id").cast("long"), file_key(F.col("req_filename")).alias("file")).filter("req_id is not null and file is not null").distinct()
    on = lists.select(file_key(F.col("req_filename")).alias("file"), trimmed(F.col("list_name")).alias("list"))
    on = on.filter("file is not null and list in ('chosen', 'remaining')").groupBy("file").agg(F.max(F.col("list") == "chosen").alias("chosen"), F.max(F.col("list") == "remaining").alias("remaining"))
    return files.join(on, "file").groupBy("req_id").agg(F.max("chosen").alias("chosen"), F.max("remaining").alias("remaining"))


def torn_groups(records: DataFrame, lists: DataFrame) -> DataFrame:
    """(req_id, group_id) of all records of groups of two or more that have a record on `chosen` and one on `remaining`."""
    groups = materialize(related_groups(records), "groups")
    marks = groups.join(listed(records, lists), "req_id", "left").groupBy("group_id").agg(F.count("*").alias("n"), F.max("chosen").alias("c"), F.max("remaining").alias("r"))
    torn = marks.filter("n > 1 and c and r").select("group_id", "n")
    return hot_join(groups, torn, "group_id", "n", groups.count()).select("req_id", "group_id")


def closest_counts(sizes: dict[int, int], target: int, window: int = WINDOW) -> dict[int, int]:
    """How many groups of each size to take so that their total is closest to target; of equally close totals the smaller.

    sizes: number of groups by size. Exact for targets of any size. A bitset holds the totals reachable with the first
    k (size, power of two) items, largest first, and is extended until it holds the target; walking back through the
    items gives the choice. The walk keeps bitsets of about `window` bits at a level and makes the ones between them
    again, so window bears on memory and time, never on the choice.
    """
    items = []
    for size, count in sorted(sizes.items(), reverse=True):
        k = 1
        while count > 0:
            take = min(k, count)
            items.append((size, take))
            count -= take
            k *= 2

    def extended(reach: int, i: int, top: int, limit: int) -> int:
        step = items[i][0] * items[i][1]
        return (reach | reach << step) & limit if step <= top else reach

    # beyond twice the target the empty choice is closer
    top = 2 * target
    reach, end, limit = 1, 0, (1 << top + 1) - 1
    while end < len(items) and not reach >> target & 1:
        reach = extended(reach, end, top, limit)
        end += 1
    low = (reach & (1 << target + 1) - 1).bit_length() - 1
    high = reach >> target + 1
    above = target + (high & -high).bit_length() if high else None
    total = above if above is not None and above - target < target - low else low
    chosen: dict[int, int] = {}

    def walk(lo: int, hi: int, reach: int, total: int) -> int:
        """Adds what is chosen of items[lo:hi] and returns what the items before them, which reach `reach`, have to give."""
        limit = (1 << total + 1) - 1
        reach &= limit
        if reach >> total & 1:
            return total
        if hi - lo == 1:
            size, take = items[lo]
            chosen[size] = chosen.get(size, 0) + take
            return total - size * take
        step = -(-(hi - lo) // max(2, window // (total + 1)))
        marks = [reach]
        for i in range(lo, lo + (hi - lo - 1) // step * step):
            reach = extended(reach, i, total, limit)
            if (i + 1 - lo) % step == 0:
                marks.append(reach)
        while marks:
            at = lo + (len(marks) - 1) * step
            total = walk(at, min(at + step, hi), marks.pop(), total)
        return total

    walk(0, end, 1, total)
    return chosen


#: The earlier name of what fills targets of any size.
filling_counts = closest_counts


def assign_splits(groups: DataFrame, proportions: tuple[tuple[str, float], ...] = PROPORTIONS) -> DataFrame:
    """(req_id, group_id, split): groups stay whole, and the totals of the splits are as close to the proportions as group sizes allow.

    The driver holds the number of groups of each distinct size, of which there are at most the square root of
    twice the records. Splits are filled one after another, the last of the list first, by closest_counts. Of groups
    of one size, those of the smallest group_id go to the last split of the list first. Deterministic.
    """
    sizes = materialize(groups.groupBy("group_id").agg(F.count("*").alias("size")), "sizes")
    left = {s: n for s, n in sizes.groupBy("size").count().collect()}
    total = sum(s * n for s, n in left.items())
    used = dict.fromkeys(left, 0)
    bounds: list[tuple[str, int, int, int]] = []
    for name, share in reversed(proportions[1:]):
        for s, n in closest_counts({s: n for s, n in left.items() if n}, round(share * total)).items():
            if n:
                bounds.append((name, s, used[s], used[s] + n))
                used[s] += n
                left[s] -= n
    spark = groups.sparkSession
    table = F.broadcast(spark.createDataFrame(bounds, "split string, size long, lo long, hi long"))
    # rank within a size, in blocks of ids, so that no task sorts all groups of one size
    block = F.pmod(F.xxhash64("group_id"), F.lit(256))
    in_block = sizes.withColumn("block", block).withColumn("rank", F.row_number().over(Window.partitionBy("size", "block").orderBy("group_id")))
    before = sizes.withColumn("block", block).groupBy("size", "block").count().withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = in_block.join(before, ["size", "block"]).select("group_id", "size", (F.col("rank") + F.coalesce("before", F.lit(0)) - 1).alias("at"))
    where = ranked.join(table, (ranked["size"] == table["size"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left").select("group_id", ranked["size"].alias("n"), F.coalesce("split", F.lit(proportions[0][0])).alias("split"))
    return hot_join(groups, where, "group_id", "n", max(total, 1)).select("req_id", "group_id", "split")
