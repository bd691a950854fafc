"""Frequency of every distinct term or n-gram and the number of records that hold it, by sorted suffixes.

Every position of a record gives its suffix, truncated to max_terms words. Suffixes go to the partition of their
first word (with the second one, so that a frequent first word is spread), are sorted there in reverse
lexicographic order and read once with a stack that holds one count for each prefix of the suffix at hand: when
the next suffix leaves a prefix, the prefix is complete and its count moves to the prefix below.

The set of records of a prefix is kept as a count. Within a record, a suffix is marked with the length from which
on its prefixes stand there for the first time (if a prefix is new in the record, so are all longer ones);
the number of records is then the number of new occurrences, which can be added up anywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import once, words
from linkloom.runtime import materialize, together

RARE_RECORDS, RARE_OCCURRENCES, COMMON_SHARE = 2, 3, 0.10
#: Words of the suffixes of one run; the counts of single terms are its prefixes of length one.
MAX_TERMS = 3
#: Distinct suffixes that a task adds up before it sends them on.
FLUSH = 200_000


def _suffixes(max_terms: int):
    """Suffixes of the records of a partition, with occurrences and new occurrences by prefix length; the empty suffix counts the records that have a word."""
    schema = pa.schema([("suffix", pa.string()), ("n", pa.int64()), ("fresh", pa.list_(pa.int64()))])

    def flush(n: Counter[str], fresh: list[Counter[str]], words_, records: int) -> pa.RecordBatch:
        suffixes = ["", *n]
        new = [[records] + [0] * (max_terms - 1), *map(list, zip(*(map(f.__getitem__, n) for f in fresh), strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(suffixes, pa.string()), pa.array([words_, *n.values()], pa.int64()), pa.array(new, pa.list_(pa.int64()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, fresh, total, records = Counter(), [Counter() for _ in range(max_terms)], 0, 0
        for b in once(batches):
            for text in b.column("_text").to_pylist():
                found = words(text)
                if not found:
                    continue
                total += len(found)
                records += 1
                grams = [found, *(list(map(" ".join, zip(*(found[j:] for j in range(k)), strict=False))) for k in range(2, max_terms + 1))]
                suffixes = grams[-1] + [" ".join(found[i:]) for i in range(len(grams[-1]), len(found))]
                n.update(suffixes)
                seen: set[int] = set()
                for k, g in enumerate(grams):
                    # the first position of each gram; where a shorter prefix is new, this one was counted with it
                    first = set(dict(zip(reversed(g), range(len(g) - 1, -1, -1), strict=True)).values()) - seen
                    fresh[k].update([suffixes[i] for i in first])
                    seen |= first
            if len(n) > FLUSH:
                yield flush(n, fresh, total, records)
                n, fresh, total, records = Counter(), [Counter() for _ in range(max_terms)], 0, 0
        if records:
            yield flush(n, fresh, total, records)

    return run


def _stack(max_terms: int):
    """Counts of all prefixes of suffixes that come in reverse lexicographic order."""
    schema = pa.schema([("term", pa.string()), ("n_terms", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        occurrences: list[int] = []
        fresh: list[list[int]] = []
        out: list[tuple] = []

        def pop() -> None:
            k = len(path)
            n, f = occurrences.pop(), fresh.pop()
            out.append((" ".join(path), k, n, sum(f[:k])))
            path.pop()
            if path:
                occurrences[-1] += n
                fresh[-1] = [a + b for a, b in zip(fresh[-1], f, strict=True)]

        for b in batches:
            for suffix, n, f in zip(b.column("suffix").to_pylist(), b.column("n").to_pylist(), b.column("fresh").to_pylist(), strict=True):
                terms = suffix.split(" ")
                same = 0
                while same < min(len(path), len(terms)) and path[same] == terms[same]:
                    same += 1
                while len(path) > same:
                    pop()
                for t in terms[same:]:
                    path.append(t)
                    occurrences.append(0)
                    fresh.append([0] * max_terms)
                occurrences[-1] += n
                fresh[-1] = [a + c for a, c in zip(fresh[-1], f, strict=True)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        while path:
            pop()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def term_frequencies(records: DataFrame, max_terms: int = MAX_TERMS, id_col: str = "req_id", text_col: str = "req_text") -> DataFrame:
    """Rows (term, n_terms, occurrences, records, total, mark): every n-gram of one to max_terms words of the whole collection.

    `total` is the number of records with at least one word. `mark` is 'rare' if the term stands in at most 2
    records or occurs at most 3 times; otherwise 'common' if it stands in more than 10 % of those records;
    otherwise null. Rows with an id that was there already are the same record delivered again and count once;
    rows with a null id are records of their own. Null, empty and wordless texts have no terms. An empty table
    gives an empty result. Other columns are not read.
    """
    src = records.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    parts = materialize(together(src, "_id").mapInArrow(_suffixes(max_terms), "suffix string, n long, fresh array<long>"), "suffixes")
    # few rows, one per flush of a task, so the total can come to the driver
    total = parts.filter("suffix = ''").agg(F.coalesce(F.sum(F.element_at("fresh", 1)), F.lit(0))).first()[0]
    routed = parts.filter("suffix <> ''").repartition(F.substring_index("suffix", " ", min(max_terms, 2)))
    counted = routed.sortWithinPartitions(F.col("suffix").desc()).mapInArrow(_stack(max_terms), "term string, n_terms int, occurrences long, records long")
    if max_terms > 1:  # a first word may have come in several parts
        counted = counted.groupBy("term", "n_terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when((F.col("records") <= RARE_RECORDS) | (F.col("occurrences") <= RARE_OCCURRENCES), "rare").when(F.col("records") > COMMON_SHARE * F.lit(total), "common")
    return counted.withColumn("total", F.lit(total).cast("long")).withColumn("mark", mark)
