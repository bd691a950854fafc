"""Similarities of all pairs of parts: cosine of vectors, word mover's distance of word bags."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.vectors import dot, mean_vector, unit
from linkloom.runtime import materialize, spread

#: The smaller side of a scoring of all pairs is sent to all executors in blocks of at most so many rows.
BLOCK_ROWS = 20_000


def blocks(small: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> list[DataFrame]:
    """The query side in blocks of bounded size, by hash of its key."""
    n = small.count()
    k = max(1, -(-n // block_rows))
    return [small] if k == 1 else [small.filter(F.pmod(F.xxhash64(key), F.lit(k)) == i) for i in range(k)]


def cosine_pairs(code: DataFrame, req: DataFrame) -> DataFrame:
    """(code, elem, req, part, sim) for all pairs of code (code, elem, vec) and req (req, part, vec).

    Every pair is a result row, so the work is the output. Both sides are brought to length 1 once; the requirement
    side goes to all executors block after block, the code side stays in place.
    """
    c = spread(code.select("code", "elem", unit(F.col("vec")).alias("_u")))
    out = None
    for block in blocks(req.select("req", "part", unit(F.col("vec")).alias("_v")), "part"):
        scored = c.join(F.broadcast(block)).select("code", "elem", "req", "part", dot(F.col("_u"), F.col("_v")).alias("sim"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The cheapest way of moving the masses a to b, by successive shortest paths with potentials."""
    n, m = cost.shape
    flow = np.zeros((n, m))
    supply, demand = a.astype(float).copy(), b.astype(float).copy()
    u, v = np.zeros(n), np.zeros(m)
    while supply.sum() > 1e-12:
        dist_l = np.where(supply > 1e-15, 0.0, np.inf)
        dist_r, back_l, back_r = np.full(m, np.inf), np.full(n, -1), np.full(m, -1)
        done_l, done_r = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            i = int(np.argmin(np.where(done_l, np.inf, dist_l)))
            j = int(np.argmin(np.where(done_r, np.inf, dist_r)))
            di, dj = (np.inf if done_l[i] else dist_l[i]), (np.inf if done_r[j] else dist_r[j])
            if min(di, dj) == np.inf:
                break
            if di <= dj:
                done_l[i] = True
                way = di + np.maximum(cost[i] - u[i] - v, 0)
                less = (way < dist_r - 1e-15) & ~done_r
                dist_r[less], back_r[less] = way[less], i
            else:
                done_r[j] = True
                way = np.where(flow[:, j] > 1e-15, dj + np.maximum(-(cost[:, j] - u - v[j]), 0), np.inf)
                less = (way < dist_l - 1e-15) & ~done_l
                dist_l[less], back_l[less] = way[less], j
        free = np.where(demand > 1e-15, dist_r, np.inf)
        end = int(np.argmin(free))
        reach = free[end]
        u -= np.minimum(dist_l, reach)
        v += np.minimum(dist_r, reach)
        path, j = [], end
        while True:
            i = int(back_r[j])
            path.append((i, j, 1))
            if back_l[i] < 0:
                break
            j = int(back_l[i])
            path.append((i, j, -1))
        amount = min([demand[end], supply[path[-1][0]], *(flow[i, j] for i, j, s in path if s < 0)])
        for i, j, s in path:
            flow[i, j] += s * amount
        supply[path[-1][0]] -= amount
        demand[end] -= amount
    return float((flow * cost).sum())


def _transport_two(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """_transport from two words: the first takes what costs it least more than the second, as far as its mass goes."""
    more = cost[0] - cost[1]
    order = np.argsort(more, kind="stable")
    taken = np.clip(a[0] - (np.cumsum(b[order]) - b[order]), 0.0, b[order])
    return float((cost[1] * b).sum() + (taken * more[order]).sum())


def word_movers_distance(a: list[str], b: list[str], vectors: dict[str, np.ndarray]) -> float:
    """Infinite if a side has no known word or all distances are 0; 0 if both have the same single word."""
    a, b = [w for w in a if w in vectors], [w for w in b if w in vectors]
    if not a or not b:
        return float("inf")
    if len({*a, *b}) == 1:
        return 0.0
    (wa, ca), (wb, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    x, y = np.array([vectors[w] for w in wa]), np.array([vectors[w] for w in wb])
    cost = np.linalg.norm(x[:, None] - y[None], axis=2)
    return float("inf") if not cost.any() else _transport(cost, ca / ca.sum(), cb / cb.sum())


def wmd_pairs(pairs: DataFrame, word_vec: DataFrame) -> DataFrame:
    """pairs with their words a_words, b_words replaced by the exact distance `wmd`.

    Each pair brings the vectors of its own words, gathered by a join, so no worker holds the vocabulary.
    """
    p = pairs.withColumn("_id", F.xxhash64(*[c for c in pairs.columns if not c.endswith("_words")]))
    words = p.select("_id", F.explode(F.array_distinct(F.concat("a_words", "b_words"))).alias("word"))
    vecs = words.join(word_vec.select("word", "vec"), "word").groupBy("_id").agg(F.collect_list("word").alias("_ws"), F.collect_list("vec").alias("_vs"))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, ws: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([word_movers_distance(list(x), list(y), {} if w is None else {k: np.asarray(v, float) for k, v in zip(w, z, strict=True)}) for x, y, w, z in zip(a, b, ws, vs, strict=True)])

    return p.join(vecs, "_id", "left").withColumn("wmd", distance("a_words", "b_words", "_ws", "_vs")).drop("_id", "_ws", "_vs", "a_words", "b_words")


def relaxed_wmd(a: DataFrame, b: DataFrame, word_vec: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, rwmd): the larger of the two one-sided costs of moving every word to the nearest one; a lower bound of the distance.

    a is (a, word), b (b, word), with repeated words; pairs names the pairs wanted.
    """
    va, vb = (t.join(word_vec.select("word", "vec"), "word").groupBy(k, "word", "vec").agg(F.count("*").alias("n")) for t, k in ((a, "a"), (b, "b")))
    x = pairs.join(va.select("a", F.col("word").alias("wa"), F.col("vec").alias("xa"), F.col("n").alias("na")), "a").join(vb.select("b", F.col("word").alias("wb"), F.col("vec").alias("xb"), F.col("n").alias("nb")), "b")
    d = x.withColumn("d", F.sqrt(F.aggregate(F.zip_with("xa", "xb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)))
    one = d.groupBy("a", "b", "wa", "na").agg(F.min("d").alias("d")).groupBy("a", "b").agg((F.sum(F.col("d") * F.col("na")) / F.sum("na")).alias("_p"))
    two = d.groupBy("a", "b", "wb", "nb").agg(F.min("d").alias("d")).groupBy("a", "b").agg((F.sum(F.col("d") * F.col("nb")) / F.sum("nb")).alias("_q"))
    return one.join(two, ["a", "b"]).select("a", "b", F.greatest("_p", "_q").alias("rwmd"))


def _packed(rows: list, key: str) -> tuple[np.ndarray, ...]:
    """Word bags of at least one known word: keys, starts, the words' places in the vectors, shares of the words, vectors, words."""
    vecs = {w["word"]: w["vec"] for r in rows for w in r["bag"]}
    place = {w: i for i, w in enumerate(vecs)}
    n = np.array([len(r["bag"]) for r in rows], np.int64)
    share = np.array([w["n"] for r in rows for w in r["bag"]], float)
    start = np.cumsum(n) - n
    share /= np.repeat(np.add.reduceat(share, start), n) if len(n) else 1.0
    return np.array([r[key] for r in rows], np.int64), start, np.array([place[w["word"]] for r in rows for w in r["bag"]], np.int64), share, np.array(list(vecs.values()), float), np.array(list(vecs))


def wmd_all(a: DataFrame, b: DataFrame, word_vec: DataFrame, exact: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, rwmd) for all pairs of word bags a (a, word) and b (b, word), with repeated words and long keys.

    rwmd is the relaxed distance; with exact also `wmd`, which is equal to it where a side has one distinct word and is
    worked out from the costs elsewhere. Both are infinite if a side has no known word; wmd also if all distances of
    several words are 0. Every pair is a result row; b goes to all executors block after block, a stays in place.
    """
    spark = a.sparkSession
    schema = "a long, b long, rwmd double" + ", wmd double" * exact

    def bags(t: DataFrame, key: str) -> DataFrame:
        n = t.groupBy(F.col(key).cast("long").alias(key), "word").agg(F.count("*").alias("n")).join(word_vec.select("word", "vec"), "word", "left")
        return n.groupBy(key).agg(F.collect_list(F.when(F.col("vec").isNotNull(), F.struct("word", "vec", "n"))).alias("bag"))

    def run_with(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kb, sb, wb, nb, vb, tb, lone = block.value
            ends = np.append(sb, len(wb))
            for rows in (batch.slice(i, 200).to_pylist() for batch in batches for i in range(0, batch.num_rows, 200)):
                ka, sa, wa, na, va, ta = _packed([r for r in rows if r["bag"]], "a")
                none = np.array([r["a"] for r in rows if not r["bag"]], np.int64)
                for keys, others in ((none, np.append(kb, lone)), (ka, lone)):
                    if len(keys) and len(others):
                        far = np.full(len(keys) * len(others), np.inf)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(keys, len(others)), np.tile(others, len(keys)), far, far)[: 3 + exact]], names=["a", "b", "rwmd", "wmd"][: 3 + exact])
                for lo in range(0, len(kb) if len(ka) else 0, 500):
                    own = slice(ends[lo], ends[min(lo + 500, len(kb))])
                    words, at = np.unique(wb[own], return_inverse=True)
                    start, n = sb[lo : lo + 500] - ends[lo], nb[own]
                    cost = np.linalg.norm(va[:, None] - vb[words][None], axis=2)
                    there = np.add.reduceat(np.minimum.reduceat(cost[:, at], start, axis=1)[wa] * na[:, None], sa, axis=0)
                    back = np.add.reduceat(np.minimum.reduceat(cost[wa], sa, axis=0)[:, at] * n, start, axis=1)
                    far = np.maximum(there, back)
                    out = [np.repeat(ka, len(start)), np.tile(kb[lo : lo + 500], len(ka)), far.ravel()]
                    if exact:
                        true, ea, eb = far.copy(), np.append(sa, len(wa)), np.append(start, len(at))
                        for i, j in np.ndindex(*far.shape):
                            x, y = slice(ea[i], ea[i + 1]), slice(eb[j], eb[j + 1])
                            c = cost[wa[x]][:, at[y]]
                            if not c.any():
                                true[i, j] = 0.0 if c.size == 1 and ta[wa[x]] == tb[words[at[y]]] else np.inf
                            elif min(c.shape) > 1:
                                true[i, j] = _transport_two(c, na[x], n[y]) if len(c) == 2 else _transport(c, na[x], n[y])
                        out.append(true.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "rwmd", "wmd"][: len(out)])

        return run

    left, out = materialize(bags(a, "a"), "bags"), None
    right = materialize(bags(b, "b"), "bags")
    for part in blocks(right, "b", block_rows):
        rows = part.collect()
        packed = (*_packed([r for r in rows if r["bag"]], "b"), np.array([r["b"] for r in rows if not r["bag"]], np.int64))
        scored = spread(left).mapInArrow(run_with(spark.sparkContext.broadcast(packed)), schema)
        out = scored if out is None else out.unionByName(scored)
    return out


def nearest_by_wmd(a: DataFrame, b: DataFrame, word_vec: DataFrame, k: int) -> DataFrame:
    """(b, rank, a, wmd): for each b the k nearest a by the exact distance, ties by a.

    Exact for every k, as the relaxed distance is never larger (operators.nearest). Pairs without a known word are left out.
    """
    from linkloom.operators import nearest

    return nearest.nearest_bags(a, b, word_vec, k)


def subword_vectors(words: DataFrame, gram_vec: DataFrame, dims: int, shortest: int = 3, longest: int = 6) -> DataFrame:
    """(word, vec): the mean of the vectors of the known n-grams of <word>, zeros without any."""
    t = words.select("word", F.concat(F.lit("<"), "word", F.lit(">")).alias("_w"))
    sized = t.select("word", "_w", F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("_n")).filter(F.length("_w") >= F.col("_n"))
    grams = sized.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("_w") - F.col("_n") + 1), lambda i: F.substring(F.col("_w"), i, F.col("_n")))).alias("gram"))
    known = mean_vector(grams.join(gram_vec.select(F.col("word").alias("gram"), "vec"), "gram"), ["word"], "vec")
    return words.select("word").distinct().join(known, "word", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)))


def hashed_vectors(words: DataFrame, dims: int) -> DataFrame:
    """A stand-in for a word-vector model, the same in every run: components in -1..1 from hashes of the word. For tests only."""
    part = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("|", "word", i.cast("string"))), 1, 4), 16, 10).cast("long") % 2001 - 1000) / 1000.0
    return words.select("word").distinct().withColumn("vec", F.transform(F.sequence(F.lit(1), F.lit(dims)), part))


def model_vectors(texts: DataFrame, load_model, text_col: str = "text") -> DataFrame:
    """texts with `vec` from a sentence model; load_model() is called once per task and returns a function from a list of texts to a matrix."""

    @F.pandas_udf("array<double>")
    def embed(batches: "pd.Series") -> "pd.Series":
        model = load_model()
        return pd.Series([list(map(float, v)) for v in model(batches.tolist())])

    return texts.withColumn("vec", embed(text_col))


#: Labelled pairs of each kind that a pair classifier is fitted on.
SAMPLE_PAIRS = 5_000
PAIR_FEATURES = 12


def pair_features(a: list[str], b: list[str]) -> list[float]:
    """Overlaps of two word lists: as sets, by letters, by endings and beginnings, and their sizes."""
    x, y = set(a), set(b)
    gram = lambda w, n: {t[i : i + n] for t in w for i in range(max(len(t) - n + 1, 1))}
    share = lambda p, q: len(p & q) / len(p | q) if p | q else 0.0
    cover = lambda p, q: len(p & q) / len(q) if q else 0.0
    tri, bi = (gram(x, 3), gram(y, 3)), (gram(x, 2), gram(y, 2))
    return [1.0, share(x, y), cover(x, y), cover(y, x), share(*tri), cover(*tri), cover(tri[1], tri[0]), share(*bi), cover({t[:4] for t in x}, {t[:4] for t in y}), cover({t[-3:] for t in x}, {t[-3:] for t in y}), math.log1p(len(a)), math.log1p(len(b))]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def pair_probabilities(pairs: DataFrame, label: str, sample: int = SAMPLE_PAIRS) -> DataFrame:
    """pairs (a, b as word lists) with `probability`: a classifier fitted on at most `sample` pairs of each label, those of the smallest hashes; all pairs are scored.

    Where the sample has one label only, that label's share is the probability.
    """
    hash_ = F.xxhash64("a", "b")
    n = {r[0]: r[1] for r in pairs.groupBy(label).count().collect()}
    part = None
    for v in n:
        below = min(1.0, 2 * sample / n[v])
        few = pairs.filter((F.col(label) == v) & (F.pmod(hash_, F.lit(1 << 20)) < int(below * (1 << 20)))).orderBy(hash_).limit(sample).select("a", "b", label)
        part = few if part is None else part.unionByName(few)
    rows = part.collect() if part is not None else []
    x, y = np.array([pair_features(r["a"], r["b"]) for r in rows]).reshape(-1, PAIR_FEATURES), np.array([float(r[label]) for r in rows])
    weights = fit_logistic(x, y) if len(set(y.tolist())) > 1 else None
    alone = float(y.mean()) if len(y) else 0.0

    @F.pandas_udf("double")
    def probability(a: pd.Series, b: pd.Series) -> pd.Series:
        if weights is None:
            return pd.Series(np.full(len(a), alone))
        z = np.array([pair_features(list(p), list(q)) for p, q in zip(a, b, strict=True)]).reshape(-1, PAIR_FEATURES) @ weights
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return pairs.withColumn("probability", probability("a", "b"))
