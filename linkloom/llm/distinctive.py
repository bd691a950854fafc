"""How distinctive a term is per record: a two-Poisson model of every term.

The number of times a term stands in a record is taken as a mixture of two Poisson variables, one for records that
merely mention it and one for the elite set of records that are about it. Both rates and the share of the elite are
fitted by expectation-maximisation on the histogram of the term's counts over all records, records without it
included. The posterior probability of the elite component scores each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import once, words
from linkloom.operators.skew import hot_join
from linkloom.runtime import materialize, together

EM_STEPS = 30
#: Below this posterior a term says nothing about a record; the README has the recall by cut.
ELITE_CUT = 0.005


def _record_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of every record with their counts; a record delivered again is left out."""
    for b in once(batches):
        ids, lengths, sizes, terms, counts = [], [], [0], [], []
        for key, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
            found = words(text)
            if not found:
                continue
            table: dict[str, int] = {}
            for w in found:
                table[w] = table.get(w, 0) + 1
            ids.append(key)
            lengths.append(len(found))
            terms += table
            counts += table.values()
            sizes.append(len(terms))
        offsets = pa.array(sizes, pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
        ], names=["req_id", "n_words", "terms", "counts"])


def fit_two_poisson(k: np.ndarray, n: np.ndarray, total: float, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low rate, elite rate, elite share) of every row of k and n: n[i, j] records have k[i, j] occurrences, of `total` records in all.

    n is padded with zeros. The low rate never exceeds the elite rate.
    """
    df = n.sum(1)
    zeros = np.maximum(total - df, 0.0)
    mean = (k * n).sum(1) / np.maximum(df, 1e-300)
    low = np.maximum((k * n).sum(1) / max(total, 1.0) * 0.5, 1e-9)
    high = np.maximum(mean, low * 2)
    share = np.clip(df / max(total, 1.0), 1e-12, 0.5)
    for _ in range(steps):
        with np.errstate(over="ignore"):
            odds = ((1 - share) / share)[:, None] * np.exp(np.clip(k * np.log(low / high)[:, None] + (high - low)[:, None], -700, 700))
            z = 1 / (1 + odds)
            z0 = 1 / (1 + (1 - share) / share * np.exp(np.clip(high - low, -700, 700)))
        elite = (z * n).sum(1) + z0 * zeros
        rest = ((1 - z) * n).sum(1) + (1 - z0) * zeros
        high = np.maximum((z * n * k).sum(1) / np.maximum(elite, 1e-300), 1e-9)
        low = np.maximum(((1 - z) * n * k).sum(1) / np.maximum(rest, 1e-300), 1e-9)
        low, high = np.minimum(low, high), np.maximum(low, high)
        share = np.clip(elite / max(total, 1.0), 1e-12, 1 - 1e-12)
    return low, high, share


def _fit(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hist = b.column("hist")
            values = hist.values
            kk, nn = (values.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
            start = hist.offsets.to_numpy()
            width = np.diff(start)
            out = np.zeros((3, len(width)))
            order = np.argsort(width, kind="stable")
            for part in np.array_split(order, max(1, len(order) // 2000)):
                if not len(part):
                    continue
                cols = np.arange(width[part].max())
                inside = cols < width[part][:, None]
                at = np.where(inside, start[part][:, None] + cols, 0)
                out[:, part] = fit_two_poisson(kk[at], np.where(inside, nn[at], 0.0), total)
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("records"), *map(pa.array, out)], names=["term", "records", "low", "high", "share"])

    return run


def elite_posterior(count: Column) -> Column:
    """Probability that a record with `count` occurrences belongs to the term's elite set."""
    exponent = count * F.log(F.col("low") / F.col("high")) + F.col("high") - F.col("low")
    odds = (1 - F.col("share")) / F.col("share") * F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), exponent)))
    return 1 / (1 + odds)


def distinctive_terms(records: DataFrame, id_col: str = "req_id", text_col: str = "req_text") -> DataFrame:
    """Rows (req_id, term, count, n_words, records, total, elite, weight), one per record and distinct term.

    `elite` is the posterior of the two-Poisson model; `weight` the occurrences times ln((1 + total) / (1 +
    records)), divided by the Euclidean norm of this product over the record. `total` is the number of records
    with a word, `records` the number of those that hold the term. If the norm is 0 (every term stands in every
    record) the weight is 0. A record delivered again counts once; rows with a null id are left out; null, empty
    and wordless texts have no rows; an empty table gives an empty result. Other columns are not read.
    """
    src = records.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null")
    rows = materialize(together(src, "_id").mapInArrow(_record_terms, "req_id long, n_words int, terms array<string>, counts array<int>"), "record-terms")
    total, pairs = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    flat = rows.select("req_id", "n_words", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("req_id", "n_words", F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))
    hist = flat.groupBy("term", "count").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("records"), F.collect_list(F.struct(F.col("count").alias("k"), "n")).alias("hist"))
    model = materialize(hist.mapInArrow(_fit(total), "term string, records long, low double, high double, share double"), "two-poisson")
    joined = hot_join(flat, model, "term", "records", pairs)
    scored = joined.select(
        "req_id", "n_words", F.struct("term", "count", "records", elite_posterior(F.col("count")).alias("elite"), (F.col("count") * F.log(F.lit(1.0 + total) / (F.col("records") + 1))).alias("raw")).alias("x")
    )
    record = scored.groupBy("req_id", "n_words").agg(F.collect_list("x").alias("xs"), F.sqrt(F.sum(F.col("x.raw") * F.col("x.raw"))).alias("norm"))
    weight = F.when(F.col("norm") > 0, F.col("x.raw") / F.col("norm")).otherwise(F.lit(0.0))
    return record.select("req_id", "n_words", "norm", F.explode("xs").alias("x")).select(
        "req_id", F.col("x.term").alias("term"), F.col("x.count").alias("count"), "n_words", F.col("x.records").alias("records"), F.lit(total).cast("long").alias("total"), F.col("x.elite").alias("elite"), weight.alias("weight")
    )
