"""Groups of records that share most of their content although edited: an exact set-similarity join.

Records become sets of hashed runs of `shingle` words, written once; records of one set form a class. Any two
classes whose Jaccard similarity is at least t share an element among the |A| - ceil(t |A|) + 1 first ones of each,
in any fixed order of the elements. The order is by frequency, counted over all records in a sketch of fixed size,
so that the first elements are the rare ones. Prefixes are routed to tiles by element, with a hashed bitmap of their
set; an element of very many classes is cut into blocks of classes, and each two blocks make a tile of their own.
Within a tile, classes of one element are compared in size bands: only if their sizes allow the threshold, and the
number of bits in which their bitmaps differ bounds the overlap from above. What is left is verified by the exact
intersection of the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.words import hashed, mix, per_batch, runs
from linkloom.runtime import materialize, spread

SHINGLE, THRESHOLD, MIN_WORDS = 3, 0.5, 20
#: Bits of a slot of the frequency sketch, and the parts in which the tasks' counts are added up.
SKETCH_BITS, PARTS = 24, 256
SKETCH = 1 << SKETCH_BITS
#: Steps of a frequency's code per doubling: a byte holds counts up to 2**31.
CODE_STEPS = 8
#: Bits of the filter that keeps classes in no candidate pair out of the last shuffle; only its size is bounded.
FILTER_BITS = 1 << 24
#: 64-bit words of a class's bitmap.
BITMAP_WORDS = 2
#: An element of more classes than that is cut into blocks of about so many.
HOT_CLASSES = 8192
#: Up to this many copies a class is written out as all pairs; larger ones as pairs with their smallest member.
ALL_PAIRS_MAX = 64
#: Bytes of texts or elements that a worker works on at a time, and pairs of a tile it compares at a time; both bear on memory only.
_PIECE = 1 << 21
_CHUNK_PAIRS = 250_000
#: Candidate pairs of a tile that are remembered, so that they are sent once.
_SEEN_MAX = 8_000_000
_TAG = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def _pieces(b: pa.RecordBatch, *cols: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose columns cols, texts or binary values, hold about _PIECE bytes, in one row if it is larger."""
    n = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // _PIECE)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield b.slice(lo, hi - lo)


class Sets:
    """The distinct shingle sets of a batch: flat sorted elements with their bounds, the class key of each set, and the record of each set."""

    def __init__(self, b: pa.RecordBatch, shingle: int, min_words: int):
        h, counts = hashed(b.column("_text").to_pylist())
        key, owner, _ = runs(h, counts, shingle)
        keep = counts[owner] >= min_words
        key, owner = key[keep], owner[keep]
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        self.key = key
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(key) else np.empty(0, np.int64)
        self.start = np.append(first, len(key))
        self.size = np.diff(self.start)
        self.row = owner[first]
        self.id = b.column("_id").to_numpy(zero_copy_only=False)[self.row]
        with np.errstate(over="ignore"):
            a, c = (np.add.reduceat(mix(key ^ t), first) if len(key) else key for t in _TAG)
        self.hi, self.lo = (mix(x + self.size.astype(np.uint64)).view(np.int64) for x in (a, c))

    def distinct(self, known: set[tuple[int, int]]) -> np.ndarray:
        """The sets whose class the task meets for the first time."""
        keep = []
        for i, k in enumerate(zip(self.hi.tolist(), self.lo.tolist(), strict=True)):
            if k not in known:
                known.add(k)
                keep.append(i)
        return np.array(keep, np.int64)

    def flat(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into which, element) of the sets."""
        n = self.size[which]
        owner = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) + np.repeat(self.start[which] - np.cumsum(n) + n, n)
        return owner, self.key[at]


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of 8-byte numbers, as many as sizes says, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes * 8)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat 8-byte numbers of a binary column and the sizes of its rows; nulls and empty values have none."""
    col = pc.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.uint64) if data is not None and off[-1] > off[0] else np.empty(0, np.uint64)
    return flat, np.diff(off) // 8


def _write_sets(shingle: int, min_words: int):
    """Class of each record, with the class's bitmap and sorted elements where the task meets it for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for b in (p for x in batches for p in _pieces(x, "_text")):
            s = Sets(b, shingle, min_words)
            if not len(s.id):
                continue
            which = s.distinct(known)
            owner, key = s.flat(which)
            bits = np.zeros((len(which), BITMAP_WORDS * 64), np.uint8)
            bits[owner, (mix(key) % np.uint64(BITMAP_WORDS * 64)).astype(np.int64)] = 1
            first = np.zeros(len(s.id), np.int64)
            first[which] = 1
            yield pa.RecordBatch.from_arrays([
                pa.array(s.id), pa.array(s.hi), pa.array(s.lo), pa.array(s.size, pa.int32()), _binary(np.packbits(bits, axis=1), first * BITMAP_WORDS), _binary(key, first * s.size),
            ], names=["id", "hi", "lo", "size", "bitmap", "elements"])

    return run


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counts of the slots, part by part: slots that have any, and their counts."""
    sketch = np.zeros(SKETCH, np.uint32)
    for b in batches:
        slot, n = np.unique(_slot(_numbers(b.column("elements"))[0]), return_counts=True)
        sketch[slot] += n.astype(np.uint32)
    slot = np.flatnonzero(sketch)
    cut = np.searchsorted(slot, np.arange(PARTS + 1) * (SKETCH // PARTS))
    used = [k for k in range(PARTS) if cut[k + 1] > cut[k]]
    part = [slot[cut[k] : cut[k + 1]] for k in used]
    yield pa.RecordBatch.from_arrays([
        pa.array(used, pa.int32()), pa.array([(p % (SKETCH // PARTS)).astype(np.uint16).tobytes() for p in part], pa.binary()), pa.array([sketch[p].tobytes() for p in part], pa.binary()),
    ], names=["part", "slots", "counts"])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the parts, as codes of the logarithm, a byte for each slot, and as a total."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, slots, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            x = total.setdefault(part, np.zeros(SKETCH // PARTS, np.int64))
            x[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.uint32)
    for part, x in total.items():
        code = np.minimum(np.ceil(np.log2(np.maximum(x, 1)) * CODE_STEPS) + (x > 0), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([code.tobytes()], pa.binary()), pa.array([int(x.sum())], pa.int64())], names=["part", "codes", "total"])


def _frequencies(sets: DataFrame) -> tuple[np.ndarray, float]:
    """The coded frequencies of all slots, SKETCH bytes whatever the input, and the mean count of a slot."""
    rows = sets.filter("elements is not null and length(elements) > 0").select("elements").mapInArrow(_count, "part int, slots binary, counts binary").repartition("part").mapInArrow(_add_counts, "part int, codes binary, total long").collect()
    out = np.zeros((PARTS, SKETCH // PARTS), np.uint8)
    for part, codes, _ in rows:
        out[part] = np.frombuffer(codes, np.uint8)
    return out.ravel(), sum(r[2] for r in rows) / SKETCH


def _prefixes(sketch, mean: float, tiles: int, threshold: float, hot_classes: int):
    """Prefix elements of the task's classes, packed by tile: element and side, and of each class its key, size and bitmap, as arrays of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq: np.ndarray = sketch.value
        for b in batches:
            key, n = _numbers(b.column("elements"))
            owner = np.repeat(np.arange(len(n)), n)
            count = freq[_slot(key)]
            order = np.lexsort((key, count, owner))
            rank = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            # an element counted once in all records stands in one class
            keep = order[(rank < np.repeat(prefix, n)) & (count[order] > 1)]
            key, owner, count = mix(key[keep]), owner[keep], count[keep]
            lo, side = b.column("lo").to_numpy().view(np.uint64), np.zeros(len(key), np.uint8)
            # blocks of the classes of an element: what other elements of its slot may count is left out
            blocks = np.ceil((np.exp2((count.astype(float) - 1) / CODE_STEPS) - mean) / hot_classes).astype(np.int64)
            hot = np.flatnonzero(blocks > 1)
            if len(hot):
                k = blocks[hot]
                own = (mix(lo[owner[hot]]) % k.astype(np.uint64)).astype(np.int64)
                each = np.repeat(np.arange(len(hot)), k)
                other = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
                mine = own[each]
                pair = (np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other)).astype(np.uint64)
                cold = np.flatnonzero(blocks <= 1)
                side = np.append(side[cold], np.sign(other - mine) + (other != mine) * 2).astype(np.uint8)  # 0 within a block, else 1 for the later and 3 for the earlier one
                key = np.append(key[cold], mix(key[hot][each] ^ mix(pair + np.uint64(1))))
                owner = np.append(owner[cold], owner[hot][each])
            tile = (key % np.uint64(tiles)).astype(np.int64)
            order = np.lexsort((owner, tile))
            key, owner, tile, side = key[order], owner[order], tile[order], side[order]
            at, first = np.unique(tile, return_index=True)
            last = np.append(first[1:], len(tile))
            bitmap = _numbers(b.column("bitmap"))[0].reshape(-1, BITMAP_WORDS)
            size = b.column("size").to_numpy()
            cols: list[list] = [[] for _ in range(6)]
            for a, z in zip(first, last, strict=True):
                classes, local = np.unique(owner[a:z], return_inverse=True)
                for c, x in zip(cols, ((key[a:z] >> np.uint64(32)).astype(np.uint32), side[a:z], local.astype(np.uint32), lo[classes], size[classes].astype(np.int32), bitmap[classes]), strict=True):
                    c.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["tile", "elements", "sides", "local", "classes", "sizes", "bitmaps"])

    return run


def _compare(threshold: float):
    """Distinct candidate pairs of the classes of a tile: same element, size bands that allow the threshold, and bitmaps that allow it.

    A class goes by the lower half of its key here; should two classes share it, both are verified.
    """
    names = ["a_lo", "b_lo"]

    def tile_pairs(blobs: list[tuple]) -> Iterator[pa.RecordBatch]:
        element, side, cls, size, bitmap = (np.concatenate([np.frombuffer(x[i], t) for x in blobs]) for i, t in ((0, np.uint32), (1, np.uint8), (3, np.int64), (4, np.int32), (5, np.uint64)))
        bitmap = bitmap.reshape(-1, BITMAP_WORDS)
        base = np.cumsum([0, *(len(x[4]) // 4 for x in blobs)])[:-1]
        local = np.concatenate([np.frombuffer(x[2], np.uint32).astype(np.int64) + k for x, k in zip(blobs, base, strict=True)])
        # one number for each class, in the order of the class keys
        order = np.argsort(cls, kind="stable")
        new = np.append(True, np.diff(cls[order]) != 0) if len(order) else np.empty(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        cls, size, bitmap = cls[order[new]], size[order[new]], bitmap[order[new]]
        who = number[local]
        order = np.lexsort((who, size[who], element))
        element, who, side = element[order], who[order], side[order]
        keep = np.append(True, (element[1:] != element[:-1]) | (who[1:] != who[:-1]))
        element, who, side = element[keep], who[keep], side[keep]
        # the partners of a class among the following, larger ones of its element reach to size / threshold
        bound = element.astype(np.int64) << 31
        reach = np.searchsorted(bound + size[who], bound + np.floor(size[who] / threshold + 1e-9).astype(np.int64), side="right")
        n = reach - np.arange(len(who)) - 1
        seen = np.empty(0, np.int64)
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK_PAIRS)))
            m = n[lo:hi]
            a = np.repeat(np.arange(lo, hi), m)
            b = a + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            met = (side[a] == 0) | (side[a] != side[b])  # two of one block meet in the tile of that block
            a, b = who[a[met]], who[b[met]]
            # elements of only one set make at most as many bits differ as there are of them
            both = size[a].astype(np.int64) + size[b]
            differ = np.bitwise_count(bitmap[a] ^ bitmap[b]).sum(1, dtype=np.int64)
            can = (both - differ) * (1 + threshold) >= 2 * threshold * both
            code = np.unique(np.minimum(a[can], b[can]) * len(size) + np.maximum(a[can], b[can]))
            if len(seen) < _SEEN_MAX:  # repeats beyond it are dropped after the shuffle
                code = np.setdiff1d(code, seen, assume_unique=True)
                seen = np.union1d(seen, code)
            yield pa.RecordBatch.from_arrays([pa.array(cls[c]) for c in (code // len(size), code % len(size))], names=names)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            for tile, *blob in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if tile != now and blobs:
                    yield from tile_pairs(blobs)
                    blobs = []
                now = tile
                blobs.append(blob)
        if blobs:
            yield from tile_pairs(blobs)

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's marks of classes in candidate pairs, part by part, of fixed size."""
    bits = np.zeros(FILTER_BITS, bool)
    for b in batches:
        for c in ("a_lo", "b_lo"):
            bits[(b.column(c).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    parts = bits.reshape(PARTS, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(parts[k]).tobytes() for k in used], pa.binary())], names=["part", "bits"])


def _add_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, data in zip(b.column("part").to_pylist(), b.column("bits").to_pylist(), strict=True):
            x = np.frombuffer(data, np.uint8)
            total[part] = total[part] | x if part in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])


def _wanted(candidates: DataFrame) -> bytes:
    """The filter of the classes in candidate pairs, FILTER_BITS whatever the input."""
    out = np.zeros((PARTS, FILTER_BITS // PARTS // 8), np.uint8)
    for part, data in candidates.mapInArrow(_mark, "part int, bits binary").repartition("part").mapInArrow(_add_marks, "part int, bits binary").collect():
        out[part] = np.frombuffer(data, np.uint8)
    return out.tobytes()


def _chosen(wanted):
    """Rows whose class passes the filter."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.frombuffer(wanted.value, np.uint8)
        slot = (b.column("lo").to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)
        return b.filter(pa.array((bits[slot >> 3] << (slot & 7) & 128).astype(bool)))

    return per_batch(run)


def _verify(threshold: float):
    """Exact similarity of candidate pairs by intersecting their sorted arrays."""
    keys = ["a_hi", "a_lo", "b_hi", "b_lo"]

    def similar(b: pa.RecordBatch) -> pa.RecordBatch:
        (x, nx), (y, ny) = (_numbers(b.column(c)) for c in ("a_elements", "b_elements"))
        rows = np.arange(b.num_rows)
        owner, value = np.append(np.repeat(rows, nx), np.repeat(rows, ny)), np.append(x, y)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        both = np.bincount(owner[1:][(value[1:] == value[:-1]) & (owner[1:] == owner[:-1])], minlength=b.num_rows)
        sim = both / np.maximum(nx + ny - both, 1)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(sim)], names=[*keys, "similarity"]).filter(pa.array(sim >= threshold - 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in _pieces(x, "a_elements", "b_elements")):
            yield similar(b)

    return run


def near_copy_classes(records: DataFrame, id_col: str = "method_id", text_col: str = "body", shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, hot_classes: int = HOT_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): membership (id, hi, lo) gives each record of at least min_words words its class of equal sets;
    pairs (a_hi, a_lo, b_hi, b_lo, similarity) all pairs of different classes of similarity at least threshold.

    Exact. Null, empty and short texts belong to no class, rows with a null id are left out, rows delivered again
    appear once, an empty table gives empty results, other columns are not read.
    """
    spark = records.sparkSession
    src = spread(records.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null"))
    sets = materialize(src.mapInArrow(_write_sets(shingle, min_words), "id long, hi long, lo long, size int, bitmap binary, elements binary"), "sets")
    membership = sets.select("id", "hi", "lo").distinct()
    first = sets.filter("length(elements) > 0")
    codes, mean = _frequencies(first)
    sketch = spark.sparkContext.broadcast(codes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = first.select("lo", "size", "bitmap", "elements").mapInArrow(_prefixes(sketch, mean, parts, threshold, hot_classes), "tile int, elements binary, sides binary, local binary, classes binary, sizes binary, bitmaps binary")
    found = postings.repartitionById(parts, "tile").mapInArrow(_compare(threshold), "a_lo long, b_lo long")
    candidates = materialize(found.distinct(), "candidates")
    wanted = spark.sparkContext.broadcast(_wanted(candidates))
    # told apart by lo first, so that the joins on lo need no sort of their own
    chosen = first.select("hi", "lo", "elements").mapInArrow(_chosen(wanted), "hi long, lo long, elements binary").repartition("lo").dropDuplicates(["lo", "hi"])
    side = lambda p: chosen.select(*(F.col(c).alias(f"{p}_{c}") for c in ("hi", "lo", "elements")))
    full = candidates.join(side("a"), "a_lo").join(side("b"), "b_lo")
    pairs = full.select("a_hi", "a_lo", "b_hi", "b_lo", "a_elements", "b_elements").mapInArrow(_verify(threshold), "a_hi long, a_lo long, b_hi long, b_lo long, similarity double")
    return membership, pairs


def near_copy_pairs(records: DataFrame, id_col: str = "method_id", text_col: str = "body", shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """Rows (id_a, id_b, similarity), id_a < id_b: pairs of records of similarity at least threshold.

    Records of equal sets: all pairs for up to ALL_PAIRS_MAX of them; a larger group is stated as the pairs of its
    smallest id with each other member, and that id stands for it in pairs with other texts, so no link is lost
    and the output stays in proportion to the groups.
    """
    membership, pairs = near_copy_classes(records, id_col, text_col, shingle, threshold, min_words, hot_classes)
    membership = materialize(membership, "membership")
    pairs = materialize(pairs, "class-pairs")
    # a class in words, written once: its members, or for a large one its smallest; no more of its ids are ever brought together
    at = F.row_number().over(Window.partitionBy("hi", "lo").orderBy("id"))
    members = membership.withColumn("at", at).filter(F.col("at") <= ALL_PAIRS_MAX + 1).groupBy("hi", "lo").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members = members.withColumn("large", F.size("ids") > ALL_PAIRS_MAX)
    shown = materialize(members.select("hi", "lo", "large", F.when(F.col("large"), F.slice("ids", 1, 1)).otherwise(F.col("ids")).alias("ids")), "classes")
    within = shown.filter(F.size("ids") > 1).select(F.posexplode("ids").alias("i", "id_a"), "ids").select("id_a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("id_b"))
    large = membership.join(shown.filter("large").select("hi", "lo", F.col("ids")[0].alias("rep")), ["hi", "lo"]).filter("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    within = within.unionByName(large).withColumn("similarity", F.lit(1.0))
    side = lambda p: shown.select(*(F.col(c).alias(f"{p}_{c}") for c in ("hi", "lo", "ids")))
    across = pairs.join(side("a"), ["a_hi", "a_lo"]).join(side("b"), ["b_hi", "b_lo"]).select(F.explode("a_ids").alias("x"), "b_ids", "similarity").select("x", F.explode("b_ids").alias("y"), "similarity")
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    return within.unionByName(across)
