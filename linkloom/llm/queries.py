"""Queries pN_... over the driver's tables, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import code_language, distinctive, encode, leaks, near_copies, ngrams, repetition, splits
from linkloom.runtime import load, materialize

Query = Callable[[SparkSession, str], DataFrame]


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    out = code_language.language_shares(load(spark, d, "code_file"), load(spark, d, "documents"))
    return out.select("file_id", "lang", "chars", "bytes", "length", F.round("share", 6).alias("share"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = code_language.language_shares(load(spark, d, "code_file"), load(spark, d, "documents"))
    return out.filter(F.col("share") >= code_language.SHARE).select("file_id", "lang")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """The single terms of the run that counts all n-grams."""
    return ngrams.term_frequencies(load(spark, d, "issue_entry")).filter("n_terms = 1").select("term", "occurrences", "records", "total", "mark")


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.term_frequencies(load(spark, d, "issue_entry")).select("term", "n_terms", "occurrences", "records", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.term_frequencies(load(spark, d, "issue_entry")).filter("n_terms = 1 and mark is not null").select("term", "mark")


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    out = distinctive.distinctive_terms(load(spark, d, "issue_entry"))
    return out.select("req_id", "term", "count", "records", F.round("weight", 6).alias("weight"), F.round("elite", 6).alias("elite"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms whose elite posterior reaches the cut, then the exact check by weight and number of records."""
    out = distinctive.distinctive_terms(load(spark, d, "issue_entry")).filter(F.col("elite") >= distinctive.ELITE_CUT)
    return out.filter("n_words >= 12 and weight >= 0.45 and records >= 2 and records <= 0.05 * total").select("req_id", "term")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs; more than 64 copies of one set are stated as pairs with their smallest id, which stands for them in other pairs."""
    out = near_copies.near_copy_pairs(load(spark, d, "code_method"))
    return out.select(F.col("id_a").alias("method_a"), F.col("id_b").alias("method_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_copies.near_copy_pairs(load(spark, d, "code_method"))
    return splits.components(materialize(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "pairs")).select(F.col("node").alias("method_id"), F.col("root").alias("group_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_groups(load(spark, d, "issue_entry"), load(spark, d, "split_list"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(materialize(splits.related_groups(load(spark, d, "issue_entry")), "groups"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_documents(load(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_item")).filter("verbatim").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages that agree in at least 0.7 of the weight of their word pairs."""
    out = leaks.leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_item"), radius=None, min_similarity=0.7)
    return out.select("doc_id", "item_id", "windows", F.round("similarity", 6).alias("similarity"), "verbatim")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the learned list marks, after the exact check of the marked ones."""
    return repetition.repetitive_documents(load(spark, d, "documents")).filter("confirmed").select("doc_id")


def p8_marked(spark: SparkSession, d: str) -> DataFrame:
    """What the learned list alone says, with the outcome of the check: its recall and precision can be read from here."""
    return repetition.repetitive_documents(load(spark, d, "documents")).select("doc_id", "rule", "confirmed", F.round("run5_share", 6).alias("run5_share"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = repetition.repetition_statistics(load(spark, d, "documents"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.round("run5_share", 6).alias("run5_share"))


def queries() -> dict[str, Query]:
    found = (p1_found, p1_shares, p2_found, p2_terms, p2_ngrams, p3_found, p3_weights, p4_found, p4_groups, p5_found, p5_splits, p6_ids, p7_found, p7_near, p8_found, p8_marked, p8_statistics)
    return {f.__name__: f for f in found}


_WORDS = "regexp_extract_all(lower(regexp_replace(nfc_normalize({0}), '[­​﻿]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_RECORDS = f"r AS (SELECT req_id, {_WORDS.format('any_value(req_text)')} AS ws FROM issue_entry WHERE req_text IS NOT NULL GROUP BY req_id), "
_TERMS = (
    _RECORDS + "w AS (SELECT req_id, unnest(ws) AS term FROM r), tot AS (SELECT count(*) AS n FROM r WHERE len(ws) > 0), "
    "df AS (SELECT term, count(*) AS occurrences, count(DISTINCT req_id) AS records FROM w GROUP BY term)"
)
_MARK = "CASE WHEN records <= 2 OR occurrences <= 3 THEN 'rare' WHEN records > 0.10 * n THEN 'common' END"
_WEIGHTS = (
    f"WITH {_TERMS}, tf AS (SELECT req_id, term, count(*) AS c, any_value(n_words) AS n_words FROM (SELECT req_id, unnest(ws) AS term, len(ws) AS n_words FROM r) GROUP BY req_id, term), "
    "raw AS (SELECT req_id, term, c, n_words, records, n, c * ln((1 + n) / (1 + records)) AS x FROM tf JOIN df USING (term), tot), "
    "wt AS (SELECT *, CASE WHEN sum(x * x) OVER (PARTITION BY req_id) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY req_id)) ELSE 0 END AS weight FROM raw) "
)
#: The mixture of every term by thirty steps of expectation-maximisation on its histogram.
_EM = (
    _WEIGHTS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""
, hist AS (SELECT term, list(c::DOUBLE) AS k, list(m::DOUBLE) AS m, sum(m)::DOUBLE AS df, sum(c * m)::DOUBLE AS s FROM (SELECT term, c, count(*) AS m FROM tf GROUP BY term, c) GROUP BY term),
init AS (SELECT hist.*, n::DOUBLE AS n, greatest(n - df, 0) AS zeros FROM hist, tot),
em AS (
  SELECT 0 AS step, term, greatest(s / greatest(n, 1) * 0.5, 1e-9) AS low, greatest(s / greatest(df, 1e-300), 2 * greatest(s / greatest(n, 1) * 0.5, 1e-9)) AS high, least(greatest(df / greatest(n, 1), 1e-12), 0.5) AS share FROM init
  UNION ALL
  SELECT step + 1, term, least(a, b), greatest(a, b), least(greatest(elite / greatest(n, 1), 1e-12), 1 - 1e-12) FROM (
    SELECT step, term, n, elite, greatest((s - zk) / greatest(n - elite, 1e-300), 1e-9) AS a, greatest(zk / greatest(elite, 1e-300), 1e-9) AS b FROM (
      SELECT step, term, n, s, list_sum(list_transform(range(1, len(k) + 1), lambda i: z[i] * m[i])) + z0 * zeros AS elite, list_sum(list_transform(range(1, len(k) + 1), lambda i: z[i] * m[i] * k[i])) AS zk FROM (
        SELECT step, term, n, s, k, m, zeros, 1 / (1 + (1 - share) / share * exp(least(700, greatest(-700, high - low)))) AS z0,
          list_transform(k, lambda x: 1 / (1 + (1 - share) / share * exp(least(700, greatest(-700, x * ln(low / high) + high - low))))) AS z
        FROM em JOIN init USING (term) WHERE step < {distinctive.EM_STEPS})))),
model AS (SELECT term, low, high, share FROM em WHERE step = {distinctive.EM_STEPS}) """
)
_NAME = "lower(regexp_replace({0}, '^[\\s ]+|[\\s ]+$', '', 'g'))"
_RAW = "CASE WHEN {0} NOT IN ('', 'unknown', 'n/a', 'tbd', '-') AND {1} NOT IN ('', 'unknown', 'n/a', 'tbd', '-') THEN {1} END"
_FILE = "nullif(regexp_replace(regexp_replace(" + _NAME + ", '^.*[/\\\\]', ''), '\\.txt$', ''), '')"
_GROUPS = f"""
WITH RECURSIVE rec AS (SELECT req_id, any_value(author) AS author, any_value(source_doc) AS source_doc, any_value(entity) AS entity, any_value(req_filename) AS req_filename FROM issue_entry GROUP BY req_id),
nm AS (SELECT req_id, {_NAME.format('author')} AS a, {_NAME.format('source_doc')} AS s, {_NAME.format('entity')} AS e FROM rec),
keys AS (
  SELECT req_id, 'a' AS kind, {_RAW.format('a', "trim(split_part(a, '@', 1))")} AS k FROM nm
  UNION SELECT req_id, 's', {_RAW.format('s', "trim(regexp_replace(regexp_replace(s, '^.*[/\\\\]', ''), '[.][^.]*$', ''))")} FROM nm
  UNION SELECT req_id, 'e', {_RAW.format('e', "regexp_replace(e, '[^\\p{L}\\p{N}]', '', 'g')")} FROM nm),
hub AS (SELECT kind, k, min(req_id) AS h FROM keys WHERE k IS NOT NULL GROUP BY kind, k),
edge AS (SELECT DISTINCT req_id AS x, h AS y FROM keys JOIN hub USING (kind, k) WHERE req_id <> h),
both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
reach(x, y) AS (SELECT req_id, req_id FROM rec UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
grp AS (SELECT x AS req_id, min(y) AS group_id FROM reach GROUP BY x),
"""
_DOCS = f"d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL), "


def _runs(table: str, key: str, n: int) -> str:
    return f"SELECT {key}, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {table})"


_COPIES = f"""m AS (SELECT method_id, {_WORDS.format('any_value(body)')} AS ws FROM code_method WHERE body IS NOT NULL GROUP BY method_id),
g AS (SELECT DISTINCT method_id, g FROM ({_runs("(SELECT * FROM m WHERE len(ws) >= 20)", 'method_id', 3)})),
n AS (SELECT method_id, count(*) AS n FROM g GROUP BY method_id),
p AS (SELECT a.method_id AS method_a, b.method_id AS method_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.method_id < b.method_id GROUP BY 1, 2),
near AS (SELECT method_a, method_b FROM p JOIN n x ON x.method_id = method_a JOIN n y ON y.method_id = method_b WHERE c >= 0.5 * (x.n + y.n - c))"""


def oracle_sql() -> dict[str, str]:
    p8 = (
        f"WITH {_DOCS}g AS ({_runs('d', 'doc_id', 5)}), rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM g) WHERE k > 1), "
        "cov AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id), "
        "st AS (SELECT a.doc_id, coalesce(len(d.ws), 0) AS n_words, coalesce(c, 0) / greatest(coalesce(len(d.ws), 0), 1) AS run5_share FROM documents a LEFT JOIN d USING (doc_id) LEFT JOIN cov USING (doc_id)) "
    )
    return {
        "p2_found": f"WITH {_TERMS} SELECT term, mark FROM (SELECT term, {_MARK} AS mark FROM df, tot) WHERE mark IS NOT NULL",
        "p2_terms": f"WITH {_TERMS} SELECT term, occurrences, records, n AS total, {_MARK} AS mark FROM df, tot",
        "p2_ngrams": f"WITH {_RECORDS} tot AS (SELECT count(*) AS n FROM r WHERE len(ws) > 0), "
        + "g AS (" + " UNION ALL ".join(f"SELECT req_id, {k}::INTEGER AS n_terms, g AS term FROM ({_runs('r', 'req_id', k)})" for k in (1, 2, 3))
        + f"), df AS (SELECT term, n_terms, count(*) AS occurrences, count(DISTINCT req_id) AS records FROM g GROUP BY term, n_terms) SELECT term, n_terms, occurrences, records, {_MARK} AS mark FROM df, tot",
        "p3_found": _WEIGHTS + "SELECT req_id, term FROM wt WHERE n_words >= 12 AND weight >= 0.45 AND records >= 2 AND records <= 0.05 * n",
        "p3_weights": _EM + "SELECT req_id, term, c AS count, records, round(weight, 6) AS weight, round(1 / (1 + (1 - share) / share * exp(least(700, greatest(-700, c * ln(low / high) + high - low)))), 6) AS elite FROM wt JOIN model USING (term)",
        "p4_found": f"WITH {_COPIES} SELECT method_a, method_b FROM near",
        "p4_groups": f"WITH RECURSIVE {_COPIES}, both_ways AS (SELECT method_a AS x, method_b AS y FROM near UNION SELECT method_b, method_a FROM near), reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y) SELECT x AS method_id, min(y) AS group_id FROM reach GROUP BY x",
        "p5_found": _GROUPS + f"""
lst AS (SELECT {_FILE.format('req_filename')} AS f, bool_or({_NAME.format('list_name')} = 'chosen') AS c, bool_or({_NAME.format('list_name')} = 'remaining') AS r FROM split_list GROUP BY 1),
mk AS (SELECT group_id, count(*) AS n, bool_or(c) AS c, bool_or(r) AS r FROM grp JOIN rec USING (req_id) LEFT JOIN lst ON lst.f = {_FILE.format('req_filename')} GROUP BY group_id)
SELECT req_id, group_id FROM grp JOIN mk USING (group_id) WHERE n > 1 AND c AND r""",
        "p7_found": f"WITH {_DOCS}q AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM eval_item WHERE text IS NOT NULL), qg AS ({_runs('q', 'item_id', 10)}), dg AS ({_runs('d', 'doc_id', 10)}) "
        "SELECT DISTINCT doc_id, item_id FROM dg JOIN qg USING (g)",
        "p7_near": f"""
WITH {_DOCS}q AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM eval_item WHERE text IS NOT NULL),
qw AS (SELECT DISTINCT item_id, ws[i:i + 9] AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM q)),
win AS (SELECT w, row_number() OVER () AS k FROM (SELECT DISTINCT w FROM qw)),
kp AS (SELECT k, p, count(*) AS c FROM (SELECT k, w[j] || ' ' || w[j + 1] AS p FROM (SELECT k, w, unnest(range(1, 10)) AS j FROM win)) GROUP BY ALL),
wt AS (SELECT p, ln(1 + (SELECT count(*) FROM win) / sum(c)) AS x FROM kp GROUP BY p),
kw AS (SELECT k, sum(x) AS total FROM kp JOIN wt USING (p) GROUP BY k),
dp AS (SELECT doc_id, j, ws[j] || ' ' || ws[j + 1] AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS j FROM d WHERE len(ws) >= 10)),
dw AS (SELECT doc_id, unnest(range(greatest(1, j - 8), j + 1)) AS i, p FROM dp),
n AS (SELECT doc_id, len(ws) AS n FROM d),
dd AS (SELECT DISTINCT doc_id, i, p FROM dw JOIN n USING (doc_id) WHERE i + 9 <= n),
dt AS (SELECT doc_id, i, sum(coalesce(x, ln(1 + (SELECT count(*) FROM win)))) AS total FROM dd LEFT JOIN wt USING (p) GROUP BY doc_id, i),
shared AS (SELECT doc_id, i, k, sum(x) AS b FROM dd JOIN wt USING (p) JOIN kp USING (p) GROUP BY doc_id, i, k),
sim AS (SELECT doc_id, i, k, b / (dt.total + kw.total - b) AS s FROM shared JOIN dt USING (doc_id, i) JOIN kw USING (k)),
hit AS (SELECT doc_id, i, k, s, d.ws[i:i + 9] = win.w AS v, win.w FROM sim JOIN d USING (doc_id) JOIN win USING (k) WHERE s >= 0.7 - 1e-12)
SELECT doc_id, item_id, count(*) AS windows, round(max(s), 6) AS similarity, bool_or(v) AS verbatim FROM hit JOIN qw USING (w) GROUP BY doc_id, item_id""",
        "p8_found": p8 + "SELECT doc_id FROM st WHERE run5_share >= 0.3",
        "p8_statistics": p8 + "SELECT doc_id, n_words, round(run5_share, 6) AS run5_share FROM st",
    }
