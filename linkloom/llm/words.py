"""Words of a text and their hashes, the same for all operators of this package.

A word is a maximal run of letters and digits of the text that was composed (NFC), freed of U+00AD, U+200B
and U+FEFF, and lower-cased, in this order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_WORD = re.compile(r"[^\W_]+")
_DROP = dict.fromkeys((0x00AD, 0x200B, 0xFEFF))
_KNOWN: dict[str, int] = {}
KNOWN_MAX = 400_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(normalize("NFC", text).translate(_DROP).lower())


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts in a row, and the number of words of each text.

    Hashes of words seen lately are kept, at most KNOWN_MAX of them.
    """
    known = _KNOWN
    if len(known) > KNOWN_MAX:
        known.clear()
    out, counts = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        found = words(text)
        counts[i] = len(found)
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
    return np.array(out, np.uint64), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text: (hash, text index, position of its first word in h)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total = len(h) - n + 1
    at = np.flatnonzero(owner[:total] == owner[n - 1 :])
    acc = np.zeros(len(at), np.uint64)
    for k in range(n):
        acc = mix(acc * _MIX[0] + h[at + k])
    return acc, owner[at], at


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over every Arrow batch, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def once(batches: Iterator[pa.RecordBatch], key: str = "_id") -> Iterator[pa.RecordBatch]:
    """The first row of each key, where rows of one key come next to each other; all rows with a null key."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        before = pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, len(keys) - 1)])
        last = keys[len(keys) - 1].as_py()
        yield b.filter(pc.fill_null(pc.not_equal(keys, before), True))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
