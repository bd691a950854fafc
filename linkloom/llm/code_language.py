"""Natural language hidden inside code: text of comments and string literals, its language and its share of each file.

A scanner takes every file apart once and emits its spans (a comment, or a literal with the pieces it is put
together from). Spans are deduplicated by a 128-bit hash, each distinct span is classified once, and the labels
are joined back to add up the shares of every file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import once
from linkloom.operators.skew import hot_join
from linkloom.runtime import materialize, together

LANGUAGES = ("de", "en", "es", "fr", "it")
SHARE = 0.05
#: Labelled documents per language that the language model is fitted on, and their lengths.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 60, (200, 20_000)
#: Hash ranges of each language, of which each gives one document to choose from.
SAMPLE_BUCKETS = 256

_C_TOKEN = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n\r]*|"""(?:[^\\]|\\.)*?(?:"""|\Z)|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.){1,8}\'', re.S)
_PY_TOKEN = re.compile(r'#[^\n\r]*|[rbuf]{0,2}(?:"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\')', re.S)
_GLUE = re.compile(r"[\s+\\]*(?:\+[^;{}\"]*\+[\s\\]*)?")
_LIST = re.compile(r"\s*,\s*")
_ESCAPE = re.compile(r"\\(?:u+([0-9a-fA-F]{4})|([0-7]{1,3})|(.))", re.S)
# What the escapes of C and Java stand for.
_PLAIN = {"n": "\n", "t": " ", "r": "\n", "b": " ", "f": " ", "0": " "}
_SQL = re.compile(r"\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|MERGE|WITH|AND|OR|WHERE|SET|VALUES|ORDER BY|GROUP BY|JOIN|FROM|HAVING)\b|.*\b(?:WHERE|VALUES|FROM)\b.*[=(]", re.S)
_QUOTED = re.compile(r"'((?:[^']|'')*)'|\"([^\"]*)\"")
_CODE_LINE = re.compile(r"[;{}]\s*$|==|!=|&&|\|\||^\s*[\w.]+\([^)]*\)\s*;?\s*$|^\s*[\w.]+\s*=\s|^\s*(?:import|package|#include)\b")
_MARKER = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+(?!/)|//+!?|#+!?)[ \t]?|\*+/[ \t]*$", re.M)
_TAG = re.compile(r"\{@\w+[^}\n]*\}|@(?:see|since|param|return|returns|throws|author|version)\b[^\n]*")
_NOISE = re.compile(r"\b\w+://\S*|\S+@\S+\.\S+|<[^<>\n]{0,40}>|&\w+;|%[-0-9.]*[a-zA-Z]|(?:^|(?<=\s))[./~]?(?:[\w.-]*/)+[\w.*-]*", re.M)
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|NOTE)\b[:(]*")
_SENTENCE = re.compile(r"(?<=[.?!])[\s\"'»)]+(?=[^\Wa-z\d_]|[¿¡«\"(])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2], 8)) if m[2] else _PLAIN.get(m[3], m[3]), text)


def _is_word(token: str) -> bool:
    """A word of prose: letters only, not camel case; upper case throughout is shouting."""
    t = token.strip(".,;:!?()[]«»“”„\"'’¿¡-…*>")
    return bool(t) and _WORD.fullmatch(t) is not None and (t[1:] == t[1:].lower() or t == t.upper() or "'" in t or "’" in t)


def prose(text: str, labels: bool = False) -> str:
    """The text without code, addresses, paths and format strings; empty if what is left isn't prose.

    Prose has at least three words, and three words in five parts; a list of labels may have fewer.
    """
    lines = [x for x in _TAG.sub(" ", text).split("\n") if not _CODE_LINE.search(_TODO.sub("", x))]
    text = _NOISE.sub(" ", _TODO.sub(" ", "\n".join(lines)))
    parts = text.split()
    good = sum(map(_is_word, parts))
    if good < (1 if labels else 3) or good * 5 < len(parts) * 3:
        return ""
    return " ".join(parts)


def _literal(token: str) -> str:
    body = token.lstrip("rbuf")
    n = 3 if body[:3] in ('"""', "'''") else 1
    return _unescape(body[n : -n if body[-n:] == body[:n] and len(body) >= 2 * n else None])


def _sql_texts(sql: str) -> Iterator[str]:
    for m in _QUOTED.finditer(sql):
        yield (m[1] or m[2] or "").replace("''", "'")


def _spans(content: str, python: bool) -> Iterator[str]:
    """The prose of a source by sentence: of each run of comments and each literal, put together from its pieces. A sentence may be in another language than the next."""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    comment: list[str] = []
    pieces: list[list[str]] = []  # a list of literals, each of pieces
    end = -1

    def literals() -> Iterator[str]:
        whole = ["".join(p) for p in pieces]
        pieces.clear()
        plain = []
        for w in whole:
            if _SQL.match(w):
                for t in _sql_texts(w):
                    if p := prose(t):
                        yield p
            else:
                plain.append(w)
        if len(plain) > 2:
            if p := prose("\n".join(plain), labels=True):
                yield p
        else:
            for w in plain:
                if p := prose(_MARKER.sub("", w)):
                    yield p

    for m in (_PY_TOKEN if python else _C_TOKEN).finditer(content):
        token, gap = m[0], content[end : m.start()] if end >= 0 else None
        is_comment = token[0] in "/#"
        single = is_comment and token[:2] != "/*"
        if comment and not (single and gap is not None and not gap.strip() and comment[-1][:2] != "/*"):
            if p := prose(_MARKER.sub("", "\n".join(comment))):
                yield p
            comment.clear()
        if is_comment:
            if pieces:
                yield from literals()
            comment.append(token)
        else:
            if not python and token[0] == "'":
                continue
            text = _literal(token)
            if pieces and gap is not None and _GLUE.fullmatch(gap):
                pieces[-1].append(text if "+" not in gap.strip("+\\ \t\n") else f" ? {text}")
            elif pieces and gap is not None and _LIST.fullmatch(gap):
                pieces.append([text])
            else:
                yield from literals()
                pieces.append([text])
        end = m.end()
    if comment and (p := prose(_MARKER.sub("", "\n".join(comment)))):
        yield p
    yield from literals()


def spans(content: str, python: bool) -> Iterator[str]:
    for span in _spans(content, python):
        yield from (x for x in _SENTENCE.split(span) if x)


def is_python(name: str | None, content: str) -> bool:
    if name and "." in name:
        return name.strip().lower().endswith(".py")
    return re.search(r"^\s*(?:def \w+\(.*\):|class \w+.*:)\s*$", content, re.M) is not None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, length, hash, weight, text) of every span; the task sends the text of a span once."""
    known: set[int] = set()
    names = ["file_id", "length", "hi", "lo", "weight", "bytes", "text"]
    for b in once(batches, "file_id"):
        out: list[tuple] = []
        for key, name, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for text in spans(content, is_python(name, content)):
                h = xxhash.xxh3_128_intdigest(text)
                first = h not in known
                if first and len(known) < 1_000_000:
                    known.add(h)
                hi, lo = (x - (1 << 64) if x >> 63 else x for x in (h >> 64, h & (1 << 64) - 1))
                out.append((key, len(content), hi, lo, len(text), len(text.encode("utf-8", "replace")), text if first else None))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


class LanguageModel:
    """Naive Bayes over character n-grams of one to three letters within words, and whole words."""

    def __init__(self, samples: dict[str, list[str]]):
        counts = {lang: Counter(f for t in texts for f in self.features(t)) for lang, texts in samples.items()}
        self.languages = sorted(counts)
        known = {f for c in counts.values() for f, n in c.items() if n > 1}
        totals = {lang: sum(c[f] for f in known) + len(known) for lang, c in counts.items()}
        self.rows = {f: i for i, f in enumerate(sorted(known))}
        self.weights = np.array([[math.log((counts[lang][f] + 1) / totals[lang]) for lang in self.languages] for f in self.rows]).reshape(-1, len(self.languages))

    @staticmethod
    def features(text: str) -> Iterator[str]:
        for w in _WORD.findall(text.lower()):
            x = f" {w} "
            yield x
            for n in (1, 2, 3):
                for i in range(len(x) - n + 1):
                    yield x[i : i + n]

    def classify(self, text: str) -> str | None:
        got = [self.rows[f] for f in self.features(text) if f in self.rows]
        return self.languages[int(np.argmax(self.weights[got].sum(0)))] if got else None


def fit_language_model(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """A model fitted on at most per_language documents of each language; None without any.

    Of every language and hash range the document of the smallest hash is looked up by its id and language alone,
    so the texts are read once, and at most SAMPLE_BUCKETS of a language come to the driver.
    """
    lang, rank = F.lower(F.trim("lang")), F.xxhash64("doc_id", F.lower(F.trim("lang")))
    labelled = docs.select(lang.alias("lang"), rank.alias("rank"), "text").filter(F.col("lang").isin(*LANGUAGES))
    drawn = [r[0] for r in labelled.groupBy("lang", F.pmod("rank", F.lit(SAMPLE_BUCKETS))).agg(F.min("rank").alias("rank")).select("rank").collect()]
    size = F.length("text")
    rows = labelled.filter(F.col("rank").isin(drawn) & (size >= SAMPLE_CHARS[0]) & (size <= SAMPLE_CHARS[1])).dropDuplicates(["lang", "rank"]).collect() if drawn else []
    samples: dict[str, list[str]] = {}
    for name, _, text in sorted(rows, key=lambda r: (r.lang, r.rank)):
        if len(samples.setdefault(name, [])) < per_language:
            samples[name].append(text)
    return LanguageModel(samples) if samples else None


def _classify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = pa.array([model.value.classify(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), lang], names=["key", "n", "lang"])

    return run


def language_shares(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (file_id, lang, chars, bytes, length, share) for every file and each language found in it.

    `length` is the number of characters of the content, `chars` and `bytes` those of the natural-language text,
    `share` chars / length. A file delivered again counts once; null and empty contents have no rows, rows with a
    null file_id are left out; the scanner takes damaged sources as they are (an unclosed comment or literal ends
    with the file or line). Without labelled documents nothing can be told apart and the result is empty, as it
    is for an empty table.
    """
    spark = files.sparkSession
    src = files.filter("file_id is not null and content is not null and content <> ''").select(F.col("file_id").cast("long"), "file_name", "content")
    found = materialize(together(src, "file_id").mapInArrow(_scan, "file_id long, length long, hi long, lo long, weight long, bytes long, text string"), "spans")
    model = fit_language_model(docs)
    if model is None:
        return spark.createDataFrame([], "file_id long, lang string, chars long, bytes long, length long, share double")
    distinct = found.groupBy(F.struct("hi", "lo").alias("key")).agg(F.count("*").alias("n"), F.first("text", ignorenulls=True).alias("text"))
    labels = materialize(distinct.mapInArrow(_classify(spark.sparkContext.broadcast(model)), "key struct<hi:long,lo:long>, n long, lang string").filter("lang is not null"), "labels")
    joined = hot_join(found.select("file_id", "length", "weight", "bytes", F.struct("hi", "lo").alias("key")), labels, "key", "n", found.count())
    out = joined.groupBy("file_id", "lang").agg(F.sum("weight").alias("chars"), F.sum("bytes").alias("bytes"), F.max("length").alias("length"))
    return out.withColumn("share", F.col("chars") / F.col("length"))
