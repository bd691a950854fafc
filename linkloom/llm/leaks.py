"""Evaluation texts leaking into training text.

Passages are windows of `window` words. Every window of an item and of a document gets a 64-bit SimHash of its
words. The fingerprint is cut into radius + 1 blocks of bits: two fingerprints within the Hamming radius agree in
at least one block, so looking up all blocks finds every such pair. Candidates are verified by the weighted
similarity of their word pairs and, for verbatim passages, word by word.

Edited passages differ in more bits than a small radius allows. With radius None, candidates are the windows that
share a word pair among their rarest ones, which are as many as the similarity asked for needs, and none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import hashed, mix, runs
from linkloom.runtime import spread

WINDOW = 10
RADIUS = 3
#: Item windows searched at once; more items are searched block after block, each over all documents.
BLOCK_WINDOWS = 200_000
_CHUNK = 1 << 16
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int64()), ("similarity", pa.float64()), ("verbatim", pa.bool_())])


def simhash(h: np.ndarray, window: int) -> np.ndarray:
    """The fingerprint of every window of consecutive words: a bit is set if most of the window's word hashes have it."""
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
    dtype = np.uint8 if window < 256 else np.uint32
    sums = np.zeros((len(h) + 1, 64), dtype)
    np.cumsum(bits, axis=0, dtype=dtype, out=sums[1:])
    return np.packbits(sums[window:] - sums[:-window] > window // 2, axis=1).view(np.uint64).ravel()


@dataclass
class ItemIndex:
    """Distinct windows of a block of items, with an inverted list of their fingerprints for each block of bits."""

    window: int
    radius: int | None
    words: np.ndarray  # (n, window) word hashes
    prints: np.ndarray  # (n,)
    owners: np.ndarray  # item ids, by window
    owner_start: np.ndarray  # (n + 1,)
    starts: list[np.ndarray]
    members: list[np.ndarray]
    pair_hash: np.ndarray  # sorted hashes of the word pairs of all items
    pair_weight: np.ndarray
    top_weight: float
    min_similarity: float = 1.0
    rank: np.ndarray | None = None  # of the word pairs, the heaviest first

    def blocks(self, prints: np.ndarray) -> Iterator[np.ndarray]:
        width = 64 // (self.radius + 1)
        for k in range(self.radius + 1):
            yield ((prints >> np.uint64(k * width)) & np.uint64((1 << min(width, 16)) - 1)).astype(np.int64)

    @classmethod
    def build(cls, ids: list[int], texts: list[str], window: int, radius: int | None, min_similarity: float = 1.0) -> ItemIndex:
        h, counts = hashed(texts)
        key, owner, at = runs(h, counts, window)
        order = np.lexsort((np.array(ids, np.int64)[owner], key)) if len(key) else np.empty(0, np.int64)
        key, item, at = key[order], np.array(ids, np.int64)[owner[order]], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        keep = new.copy()
        keep[1:] |= item[1:] != item[:-1]
        owner_start = np.append(np.flatnonzero(new[keep]), keep.sum())
        w = h[at[new][:, None] + np.arange(window)] if len(key) else np.empty((0, window), np.uint64)
        prints = simhash(h, window)[at[new]] if len(key) and radius is not None else np.empty(0, np.uint64)
        pairs, df = np.unique(_pairs(w), return_counts=True)
        weight = np.log1p(len(w) / np.maximum(df, 1))
        self = cls(window, radius, w, prints, item[keep], owner_start, [], [], pairs, weight, math.log1p(max(len(w), 1)))
        for b in self.blocks(prints) if radius is not None else ():
            self.members.append(np.argsort(b, kind="stable"))
            self.starts.append(np.searchsorted(b[self.members[-1]], np.arange((1 << min(64 // (radius + 1), 16)) + 1)))
        if radius is None:
            self.min_similarity = min_similarity
            self.rank = np.empty(len(pairs), np.int64)
            self.rank[np.lexsort((pairs, -weight))] = np.arange(len(pairs))
            row, rank = self._rarest(_pairs(w))
            order = np.argsort(rank, kind="stable")
            self.members.append(row[order])
            self.starts.append(np.searchsorted(rank[order], np.arange(len(pairs) + 1)))
        return self

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, window) within the radius."""
        found = []
        for b, start, member in zip(self.blocks(prints), self.starts, self.members, strict=True):
            lo, n = start[b], start[b + 1] - start[b]
            hit = np.flatnonzero(n)
            n = n[hit]
            pos = np.repeat(hit, n)
            k = member[np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[pos] ^ self.prints[k]) <= self.radius
            found.append(pos[near] * len(self.prints) + k[near])
        code = np.unique(np.concatenate(found))
        return code // max(len(self.prints), 1), code % max(len(self.prints), 1)

    def _known(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.pair_hash, pairs), len(self.pair_hash) - 1)
        return k, self.pair_hash[k] == pairs

    def _rarest(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, rank) of the items' word pairs among the rarest ones of each window.

        All that two similar windows share weighs at least min_similarity times each of them. The rarest shared pair
        is thus followed, itself included, by that much weight in both; pairs with less from there on are left out.
        """
        k, known = self._known(pairs)
        weight = np.where(known, self.pair_weight[k], self.top_weight) * _first(pairs)
        rank = np.where(known, self.rank[k], -1)
        order = np.argsort(rank, axis=1, kind="stable")
        rank, weight = np.take_along_axis(rank, order, 1), np.take_along_axis(weight, order, 1)
        rest = np.cumsum(weight[:, ::-1], axis=1)[:, ::-1]
        row, at = np.nonzero((rest >= self.min_similarity * rest[:, :1] - 1e-9) & (rank >= 0) & (weight > 0))
        return row, rank[row, at]

    def sharing(self, part: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (position in part, window) that can reach min_similarity, for the windows of part that begin at inside."""
        if not len(inside):
            return
        width = self.window - 1
        pairs = _pairs(part[None])[0]
        k, known = self._known(pairs)
        again = np.zeros(len(pairs), bool)
        for step in range(1, width):
            again[step:] |= pairs[step:] == pairs[:-step]
        # Bounds of the known and the unknown weight: known pairs count each time, unknown ones unless they come again shortly.
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (np.where(known, self.pair_weight[k], 0.0), np.where(known | again, 0.0, self.top_weight))]
        have, lack = (x[inside + width] - x[inside] for x in sums)
        can = inside[(have > 1e-6) & (have * (1 - self.min_similarity) >= self.min_similarity * lack - 1e-6)]
        start, member = self.starts[0], self.members[0]
        for c in range(0, len(can), 20_000):
            at = can[c : c + 20_000]
            row, rank = self._rarest(pairs[at[:, None] + np.arange(width)])
            n = start[rank + 1] - start[rank]
            cuts = np.searchsorted(np.cumsum(np.bincount(row, n, len(at))), np.arange(1, n.sum() // 1_000_000 + 1) * 1_000_000)
            for lo, hi in zip(np.searchsorted(row, [0, *cuts]), np.searchsorted(row, [*cuts, len(at)]), strict=True):
                m = n[lo:hi]
                found = member[np.repeat(start[rank[lo:hi]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                code = np.unique(np.repeat(row[lo:hi], m) * len(self.words) + found)
                yield at[code // len(self.words)], code % len(self.words)

    def _weights(self, pairs: np.ndarray) -> np.ndarray:
        k, known = self._known(pairs)
        return np.where(known, self.pair_weight[k], self.top_weight)

    def similarity(self, doc_words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of the word pairs of document windows (c, window) and item windows k; rare pairs weigh more."""
        a, b = _pairs(doc_words), _pairs(self.words[k])
        wa, wb = self._weights(a) * _first(a), self._weights(b) * _first(b)
        both = (wa * (a[:, :, None] == b[:, None, :]).any(2)).sum(1)
        return both / (wa.sum(1) + wb.sum(1) - both)


def _pairs(w: np.ndarray) -> np.ndarray:
    return mix(w[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + w[:, 1:])


def _first(a: np.ndarray) -> np.ndarray:
    """Marks the first of equal values in a row."""
    same = a[:, :, None] == a[:, None, :]
    return ~np.tril(same, -1).any(2)


def _candidates(ix: ItemIndex, part: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if ix.radius is None:
        yield from ix.sharing(part, inside)
    else:
        pos, k = ix.candidates(simhash(part, ix.window)[inside])
        yield inside[pos], k


def _search(index, min_similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: ItemIndex = index.value
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            h, counts = hashed(b.column("_text").to_pylist())
            owner = np.repeat(np.arange(len(counts)), counts)
            hits: dict[tuple[int, int], list] = {}
            for lo in range(0, max(len(h) - ix.window + 1, 0), _CHUNK):
                part = h[lo : lo + _CHUNK + ix.window - 1]
                own = owner[lo : lo + len(part)]
                inside = np.flatnonzero(own[: len(part) - ix.window + 1] == own[ix.window - 1 :])
                for pos, k in _candidates(ix, part, inside):
                    for c in range(0, len(pos), 20_000):
                        p, q = pos[c : c + 20_000], k[c : c + 20_000]
                        w = part[p[:, None] + np.arange(ix.window)]
                        sim = ix.similarity(w, q)
                        good = sim >= min_similarity - 1e-12
                        exact = (w[good] == ix.words[q[good]]).all(1)
                        for d, win, s, e in zip(own[p[good]].tolist(), q[good].tolist(), sim[good].tolist(), exact.tolist(), strict=True):
                            for item in ix.owners[ix.owner_start[win] : ix.owner_start[win + 1]].tolist():
                                x = hits.setdefault((d, item), [0, 0.0, False])
                                x[0] += 1
                                x[1] = max(x[1], s)
                                x[2] |= e
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[d] for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64()),
                *(pa.array([x[j] for x in hits.values()], _OUT.field(2 + j).type) for j in range(3)),
            ], schema=_OUT)

    return run


def _blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for i, text in items.toLocalIterator():
        ids.append(i)
        texts.append(text)
        size += len(text) // 2
        if size > block_windows:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaked_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, radius: int | None = RADIUS, min_similarity: float = 1.0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Rows (doc_id, item_id, windows, similarity, verbatim) for each document and item that share a passage.

    windows counts the pairs of windows whose fingerprints lie within the radius and whose similarity is at least
    min_similarity; with radius None, all pairs of that similarity, which must be above 0. verbatim says that one of them agrees word by word, in order. The items are a stated query
    set: they are read in blocks of bounded size, each held against all documents, so any number of them can be
    searched. Documents are not shuffled. Null, blank and short texts have no window; rows with a null id are
    left out; repeated rows count once; empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    src = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text")).filter("doc_id is not null and _text is not null"))
    queries = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    schema = "doc_id long, item_id long, windows long, similarity double, verbatim boolean"
    out = spark.createDataFrame([], schema)
    for ids, texts in _blocks(queries, window, block_windows):
        index = ItemIndex.build(ids, texts, window, radius, min_similarity)
        if len(index.words):
            out = out.unionByName(src.mapInArrow(_search(spark.sparkContext.broadcast(index), min_similarity), schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"), F.max("verbatim").alias("verbatim"))
