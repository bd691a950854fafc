"""Repetition inside a single document: statistics, and a learned decision list over them.

The statistics of every document come from one pass over the whole texts. A decision list is learned by
sequential covering on a bounded sample of labelled documents and becomes an ordered Spark CASE expression. The
share that defines the label is no feature of the list: it labels the sample and checks what the list marks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import batch, hashed, per_batch, runs
from linkloom.runtime import spread, write_table

RUN = 5
SHARE = 0.30
#: Rows of the labelled sample, the ones of the smallest hashed ids.
SAMPLE_ROWS = 5_000
#: Hash values of the sampling; a sample is cut from the rows whose hash lies below a threshold.
HASHES = 1 << 20
MAX_CONDITIONS = 3
#: The part of its value by which a learned cut is moved outwards, for documents unlike those of the sample.
SLACK = 0.15
LABEL = "run5_share"
FEATURES = ("run3_share", "run8_share", "top_word_share", "repeated_word_share", "repeated_line_share", "repeated_sentence_share", "n_words")

_OUT = pa.schema([("doc_id", pa.int64()), *((f, pa.float64()) for f in (LABEL, *FEATURES))])


def _repeated(key: np.ndarray) -> np.ndarray:
    """Marks every element that was there earlier in the array."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    if len(key):
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def _covered(h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For every text the number of words covered by runs of n words that started earlier in it."""
    key, owner, at = runs(h, counts, n)
    hit = at[_repeated(key ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))]
    edge = np.bincount(hit, minlength=len(h) + 1)[: len(h) + 1] - np.bincount(hit + n, minlength=len(h) + 1)[: len(h) + 1] if len(h) else np.zeros(1)
    inside = np.cumsum(edge)[: len(h)] > 0
    return np.bincount(np.repeat(np.arange(len(counts)), counts)[inside], minlength=len(counts))


def _pieces(text: str | None, seps: str) -> float:
    """Share of characters in lines or sentences that stood earlier in the text."""
    if not text:
        return 0.0
    for c in seps[1:]:
        text = text.replace(c, seps[0])
    seen, total, again = set(), 0, 0
    for p in text.split(seps[0]):
        p = p.strip().lower()
        if p:
            total += len(p)
            if p in seen:
                again += len(p)
            seen.add(p)
    return again / total if total else 0.0


def _statistics(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = b.column("_text").to_pylist()
    h, n = hashed(texts)
    owner = np.repeat(np.arange(len(n)), n)
    per = np.maximum(n, 1)
    key = h ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = np.bincount(owner[_repeated(key)], minlength=len(n))
    top = np.zeros(len(n))
    if len(h):
        uniq, first, count = np.unique(key, return_index=True, return_counts=True)
        np.maximum.at(top, owner[first], count)
    return batch(_OUT, b.column("doc_id"), _covered(h, n, RUN) / per, _covered(h, n, 3) / per, _covered(h, n, 8) / per, top / per, again / per, [_pieces(t, "\n\r") for t in texts], [_pieces(t, ".!?\n") for t in texts], n.astype(float))


def repetition_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, run5_share and the statistics named in FEATURES, shares in 0..1.

    run5_share is the share of words covered by runs of five words that started earlier in the document. Null,
    empty and wordless texts have all shares 0. Repeated rows give repeated rows. Other columns are not read.
    """
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")))
    return src.mapInArrow(per_batch(_statistics), ", ".join(["doc_id long", *(f"{f} double" for f in (LABEL, *FEATURES))]))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.at_least else x[self.feature] <= self.cut

    def moved(self, part: float) -> Condition:
        """The condition with its cut moved outwards by a part of its value."""
        return Condition(self.feature, self.at_least, self.cut * (1 - part if self.at_least else 1 + part))

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.cut) if self.at_least else F.col(self.feature) <= F.lit(self.cut)


def _gain(p0: int, n0: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """FOIL's information gain of going from p0, n0 covered positives and negatives to p1, n1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))
    return np.where(p1 > 0, g, -np.inf)


def _best(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest gain. A cut lies just beyond the nearest excluded value, so a rule is as general as the sample allows."""
    found: tuple[float, Condition | None] = (1e-9, None)
    p0, n0 = int(y.sum()), int((~y).sum())
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        s, pos = v[order], np.cumsum(y[order])
        neg = np.arange(1, len(s) + 1) - pos
        ends = np.flatnonzero(np.diff(s) > 0)  # conditions may split after these
        if not len(ends):
            continue
        gap = s[ends + 1] - s[ends]
        for at_least, p1, n1, cut in ((True, p0 - pos[ends], n0 - neg[ends], s[ends] + gap * 0.1), (False, pos[ends], neg[ends], s[ends + 1] - gap * 0.1)):
            g = _gain(p0, n0, p1.astype(float), n1.astype(float))
            k = int(np.argmax(g))
            if g[k] > found[0]:
                found = (float(g[k]), Condition(f, at_least, float(cut[k])))
    return found


def _holds(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(n, bool)


def _worth(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    """Share of positives among what the rule covers, with Laplace's correction."""
    hit = _holds(rule, x, len(y))
    return (float(y[hit].sum()) + 1) / (float(hit.sum()) + 2)


def learn_decision_list(x: dict[str, np.ndarray], y: np.ndarray) -> list[list[Condition]]:
    """Sequential covering: grow a conjunction on two thirds of the rows by gain, prune it on the rest, remove what it covers, repeat.

    It goes on until every positive row is covered or no condition tells one from the negatives. Deterministic.
    Returns no rule if there is no positive row; a rule of no condition, which holds always, if there is no negative one.
    """
    y = y.astype(bool)
    rules: list[list[Condition]] = []
    left = np.ones(len(y), bool)
    grow = np.arange(len(y)) % 3 != 2
    while y[left].any():
        if y[left].all():
            rules.append([])
            break
        use = left & grow if y[left & grow].any() and (~y[left & grow]).any() else left
        gx, gy, rule = {f: v[use] for f, v in x.items()}, y[use], []
        while len(rule) < MAX_CONDITIONS and (~gy).any():
            _, c = _best(gx, gy)
            if c is None:
                break
            rule.append(c)
            keep = c.holds(gx)
            gx, gy = {f: v[keep] for f, v in gx.items()}, gy[keep]
        if not rule:
            break
        test = left & ~grow if (left & ~grow).any() else left
        tx, ty = {f: v[test] for f, v in x.items()}, y[test]
        while len(rule) > 1 and _worth(rule[:-1], tx, ty) >= _worth(rule, tx, ty):
            rule.pop()
        hit = _holds(rule, x, len(y)) & left
        if y[hit].sum() < (~y[hit]).sum() or not y[hit].any():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_expression(rules: list[list[Condition]]) -> Column:
    """The ordered list as CASE WHEN ... THEN rule number ... END, null where no rule holds."""
    expr = None
    for k, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for i, c in enumerate(rule):
            cond = c.column() if i == 0 else cond & c.column()
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return F.lit(None).cast("int") if expr is None else expr


def last_rule() -> list[Condition]:
    """Holds for every positive document, as a run of five words that came before is made of runs of three that did.

    Stands at the end of a list that could not be learned in full: where the sample holds documents of one kind
    only, or positive ones that no condition tells apart.
    """
    return [Condition("run3_share", True, SHARE)]


def labelled_sample(stats: DataFrame, rows: int, total: int):
    """At most `rows` rows, those of the smallest hashed ids, as pandas.

    Only rows whose hash lies below a threshold take part, about twice as many as are asked for, so that what the
    tasks send to the driver does not grow with the table.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    below = min(HASHES, -(-2 * rows * HASHES // max(total, 1)))
    return stats.filter(part < below).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()


def learned_rules(stats: DataFrame, total: int, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """The decision list for tables of statistics, fitted on at most sample_rows documents labelled by the definition."""
    sample = labelled_sample(stats, sample_rows, total)
    x, y = {f: sample[f].to_numpy() for f in FEATURES}, (sample[LABEL] >= SHARE).to_numpy()
    rules = learn_decision_list(x, y) if y.any() and not y.all() else []
    seen = np.logical_or.reduce([_holds(r, x, len(y)) for r in rules]) if rules else np.zeros(len(y), bool)
    return [[c.moved(SLACK) for c in r] for r in rules] if rules and seen[y].all() else [*rules, last_rule()]


def repetitive_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every document with `rule`, the number of the rule of the learned list that marks it, or null, and `confirmed`.

    The list is fitted on at most sample_rows documents, labelled by the definition (covered share of at least
    0.30); it does not see that share. `confirmed` is the exact check of a marked document, null for others.
    Everything but the fit covers all documents. An empty table gives an empty result.
    """
    table = write_table(repetition_statistics(docs), "repetition", "true")
    rules = learned_rules(table.df, table.counted or 0, sample_rows)
    return table.df.withColumn("rule", as_expression(rules)).withColumn("confirmed", F.when(F.col("rule").isNotNull(), F.col(LABEL) >= SHARE))
