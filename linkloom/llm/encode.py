"""Encoding of whole texts by a public byte-level BPE vocabulary.

Texts are cut at spaces into chunks and chunks into words by the vocabulary's pattern. Each word not seen by the
worker yet is merged in DuckDB: a recursive query over rows (word, position, token) joins the merge table and
contracts the leftmost pair of minimum rank of every word until no pair is left.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.runtime import spread

TOKENIZER_DIR = os.environ.get("LINKLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Words and chunks whose ids a worker keeps; beyond it starts anew.
CACHE_MAX = 400_000
#: Longer words, in bytes, are merged with a heap instead of SQL, by the same rule.
SQL_WORD_MAX = 64

# Fixed values of byte-level BPE: the pattern that cuts words, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# White space in the sense of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Each step unnests the words still in work into rows (word, position, token, next token), joins the merge table,
#: takes each word's pair of minimum rank, leftmost first, and puts the merged token in its place.
_MERGE_SQL = """
WITH RECURSIVE step(lvl, w, toks) AS (
  SELECT 0, w, toks FROM start
  UNION ALL
  SELECT s.lvl + 1, s.w, s.toks[:b.best % 128] || [m.merged] || s.toks[b.best % 128 + 3:]
  FROM step s
  JOIN (SELECT p.w, min(m.rnk * 128 + p.pos) AS best
        FROM (SELECT w, unnest(range(len(toks))) AS pos, unnest(toks) AS tok, unnest(toks[2:]) AS nxt FROM step) p
        JOIN merges m ON m.l = p.tok AND m.r = p.nxt GROUP BY p.w) b ON b.w = s.w
  JOIN merges m ON m.rnk = b.best // 128
)
SELECT w, arg_max(toks, lvl) AS ids FROM step GROUP BY w
"""


class Encoder:
    """One per Python worker and vocabulary."""

    def __init__(self, directory: str, name: str):
        import duckdb
        import regex

        with open(os.path.join(directory, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        extra = (chr(256 + k) for k in range(256))
        letter = {b: chr(b) if b in set(PRINTABLE) else next(extra) for b in [*PRINTABLE, *(b for b in range(256) if b not in set(PRINTABLE))]}
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.cut = regex.compile(PATTERN.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(rf"[^[{SPACE}]", f"[^{SPACE}"))
        self.at_space = re.compile(f" (?=[^{SPACE}])")
        # a space before white space, for which splitting at spaces would not do
        self.odd = tuple(" " + c for k in (*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if re.match(f"[{SPACE}]", c := chr(k)))
        self.odd_ascii = tuple(x for x in self.odd if x.isascii())
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        keys = np.array(list(self.merges), np.int32).reshape(-1, 2)
        table = pa.table({"l": keys[:, 0], "r": keys[:, 1], "rnk": pa.array([v[0] for v in self.merges.values()], pa.int64()), "merged": pa.array([v[1] for v in self.merges.values()], pa.int32())})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")

    def _long(self, data: bytes) -> list[int]:
        """Leftmost pair of minimum rank first, by a heap over a linked list; for a word of n bytes n log n steps."""
        tok = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        nxt, prev = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(m[0], i) for i in range(len(tok) - 1) if (m := self.merges.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] is None or j >= len(tok) or (m := self.merges.get((tok[i], tok[j]))) is None or m[0] != rank:
                continue
            tok[i], tok[j], nxt[i] = m[1], None, nxt[j]
            if nxt[j] < len(tok):
                prev[nxt[j]] = i
            for a in (prev[i], i):
                if a >= 0 and nxt[a] < len(tok) and (m := self.merges.get((tok[a], tok[nxt[a]]))):
                    heapq.heappush(heap, (m[0], a))
        return [t for t in tok if t is not None]

    def learn(self, new: list[str]) -> None:
        """Puts the ids of words into self.words."""
        short: list[str] = []
        for w in new:
            data = w.encode("utf-8", "replace")
            if len(data) > SQL_WORD_MAX:
                self.words[w] = np.array(self._long(data), np.int32).tobytes()
            else:
                short.append(w)
        for lo in range(0, len(short), 20_000):
            part = [w.encode("utf-8", "replace") for w in short[lo : lo + 20_000]]
            n = np.array([len(p) for p in part])
            tokens = pa.array(self.byte_id[np.frombuffer(b"".join(part), np.uint8)])
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            start = pa.table({"w": pa.array(np.arange(len(part)), pa.int32()), "toks": pa.ListArray.from_arrays(ends, tokens)})
            self.db.register("start", start)
            got = self.db.sql(_MERGE_SQL).to_arrow_table()
            self.db.unregister("start")
            ids = got.column("ids").combine_chunks()
            values, offsets = ids.values.to_numpy().astype(np.int32), ids.offsets.to_numpy()
            for k, a, b in zip(got.column("w").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                self.words[short[lo + k]] = values[a:b].tobytes()

    def pieces(self, text: str) -> list[str]:
        """Chunks that no token crosses: a space before anything but white space always begins a token. All but the first stand without that space."""
        if text[-1] != " " and not any(c in text for c in (self.odd_ascii if text.isascii() else self.odd)):
            return text.split(" ")
        return self.at_space.split(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as the bytes of 32-bit integers."""
        for known in (self.chunks, self.words):
            if len(known) > CACHE_MAX:
                known.clear()
        cut = [self.pieces(t) if t else [""] for t in texts]
        chunks, heads = self.chunks, {p[0] for p in cut}
        rest = {c for p in cut for c in islice(p, 1, None)}.difference(chunks)
        parts = {c: self.cut.findall(" " + c) for c in rest}
        firsts = {c: self.cut.findall(c) for c in heads}
        self.learn([w for w in dict.fromkeys(w for d in (parts, firsts) for p in d.values() for w in p) if w not in self.words])
        for c, p in parts.items():
            chunks[c] = b"".join([self.words[w] for w in p])
        begin = {c: b"".join([self.words[w] for w in p]) for c, p in firsts.items()}
        return [begin[p[0]] + b"".join([chunks[c] for c in islice(p, 1, None)]) for p in cut]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encode(directory: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (directory, name)
        if key not in _encoders:
            _encoders[key] = Encoder(directory, name)
        enc = _encoders[key]
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                coded = enc.encode(part.column("_text").to_pylist())
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, name: str = VOCABULARY, directory: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids, the token ids of the whole text without special tokens.

    Text that looks like a special token is plain text. Null and empty texts have an empty list. Nothing is
    shuffled; repeated rows give repeated rows; other columns are not read. `directory` must be readable on every
    executor.
    """
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")))
    return src.mapInArrow(_encode(directory, name), "doc_id long, ids array<int>")
