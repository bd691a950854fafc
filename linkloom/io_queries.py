"""Queries for directories, readers, writers, registries, chains of steps, embeddings from artefacts, and labelled data."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import vectors as V
from linkloom.operators import features, graph, sampling
from linkloom.operators import links as L
from linkloom.operators import metrics as M
from linkloom.plans import domain as D
from linkloom.plans import techniques
from linkloom.plans.datasets import DATASETS, SECTIONS
from linkloom.queries import _CAMEL, _LETTERS, _MEAN_W, _PAIRS, _PRF, _RANK, _SPLIT, _SWEEP_F, _TFIDF, _WS, _cells, _first_dims, _grid, _hits, _lit, _map, _path, _rounded, query
from linkloom.runtime import first_delivery, load, materialize, spread
from linkloom.sources import readers as R
from linkloom.sources import writers as S

# --- directories and files -------------------------------------------------------------------------------------

_LINKS = "trace_link WHERE dataset IS NOT NULL AND req_filename IS NOT NULL AND code_filename IS NOT NULL"


def _links(spark, d):
    return load(spark, d, "trace_link").filter("dataset is not null and req_filename is not null and code_filename is not null").select("dataset", "req_filename", "code_filename")


@query("src01_directory", f"SELECT DISTINCT dataset AS folder, 1::BIGINT AS files FROM {_LINKS}")
def src01(spark, d):
    """One folder for each dataset, written below an output path and found again by the recursive scan."""
    p = S.output_path(_path(spark, "scan"), "links", kind="gold")
    _links(spark, d).repartition("dataset").write.partitionBy("dataset").option("header", True).csv(p)
    folder = F.regexp_extract("path", r"dataset=([^/]+)/", 1)
    return R.files(spark, p, "*.csv").groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))


@query("src03_lines", "SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS s FROM documents WHERE text IS NOT NULL))")
def src03(spark, d):
    return R.lines(load(spark, d, "documents").filter("text is not null").select("doc_id", "text"), "text").withColumn("pos", F.col("pos").cast("long"))


@query("src05_csv_renamed", f"SELECT dataset AS a, req_filename AS b, code_filename AS c FROM {_LINKS}")
def src05(spark, d):
    p = _path(spark, "csv")
    S.write_csv(_links(spark, d), p)
    return R.csv_renamed(spark, p, ["a", "b", "c"])


@query("src12_call_graph_json", f"{_PAIRS} SELECT DISTINCT 'C' || (caller // 20) || '.m' || caller AS caller, 'C' || (callee // 20) || '.m' || callee AS callee FROM cg")
def src12_json(spark, d):
    """The call graph as JSON maps of methods, one for each class, written and read again."""
    cls, name = lambda c: F.concat(F.lit("C"), F.floor(F.col(c) / 20).cast("string")), lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    calls = D.call_edges(spark, d).groupBy("caller").agg(F.collect_list(F.array(cls("callee"), name("callee"))).alias("calls"))
    none = F.array().cast("array<array<string>>")
    node = F.struct(F.concat_ws(".", cls("caller"), name("caller")), F.struct("calls", none.alias("called_by"), cls("caller").alias("class_name"), name("caller").alias("method_name"), F.array(F.lit("int")).alias("params")))
    p = _path(spark, "graph")
    S.write_json(calls.groupBy(cls("caller").alias("c")).agg(F.map_from_entries(F.collect_list(node)).alias("graph")).select("graph"), p)
    return R.call_graph(spark.read.schema(f"graph {R.CALL_GRAPH}").json(p))[1]


@query("src22_in_memory", f"{_PAIRS} SELECT file::VARCHAR AS file, count(*) AS n, round(sum(vec[1]), 6) AS x FROM elem GROUP BY 1")
def src22(spark, d):
    """Embeddings that are at hand as a table, taken as a source like stored ones."""
    e = R.embeddings_at_hand(D.elem(spark, d), "file", "id", "vec")
    return e.groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("vec", 1)), 6).alias("x"))


@query("src24_stop_words", """
SELECT 'en' AS list, unnest(string_split('abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package parameter private protected public return short static strictfp super switch synchronized this throws throw transient try void volatile while string integer get set exception array hash struct unsigned union', ' ')) AS word
UNION ALL SELECT 'it', unnest(string_split('abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package parameter private protected public return short static strictfp super switch synchronized this throws throw transient try void exception volatile while string integer ottenere settare eccezione array hash struct unsigned union', ' '))""")
def src24(spark, d):
    rows = [(name, w) for name, words in (("en", T.CODE_STOP_WORDS), ("it", T.ITALIAN_CODE_STOP_WORDS)) for w in words]
    return spark.createDataFrame(rows, "list string, word string")


@query("src25_datasets", "SELECT * FROM (VALUES ('etour', 'en', 'java', 'UTF-8', true, 'text', 0), ('etour308', 'en', 'java', 'UTF-8', true, 'text', 7), ('itrust', 'en', 'java', 'UTF-8', true, 'text', 0), ('libest', 'en', 'c', 'UTF-8', true, 'text', 1), ('smos', 'it', 'java', 'UTF-8', true, 'text', 8), ('smos_trans', 'en', 'java', 'UTF-8', true, 'text', 8), ('eanci', 'it', 'java', 'ISO-8859-1', false, 'text', 6), ('eanci_no_trans', 'it', 'java', 'ISO-8859-1', false, 'text', 6), ('dronology', 'en', 'java', 'UTF-8', true, 'json', 0), ('dronology_dd', 'en', 'java', 'UTF-8', true, 'json', 0)) v(name, language, code_language, encoding, keys_with_extension, gold_format, headers)")
def src25(spark, d):
    return spark.createDataFrame([(c.name, c.language, c.code_language, c.encoding, c.keys_with_extension, c.gold_format, len(c.headers)) for c in DATASETS.values()], "name string, language string, code_language string, encoding string, keys_with_extension boolean, gold_format string, headers int")


@query("tok05_templates", """
SELECT doc_id, regexp_matches(ln, '(?i)^use case name:?') AS etour_name, regexp_matches(ln, '(?i)^(entry conditions|entry operator conditions|entry tourist conditions):?') AS etour_entry, regexp_matches(ln, '(?i)^requirement [0-9]+:?') AS libest_name,
  regexp_matches(ln, '(?i)^precondizioni:?') AS smos_entry, regexp_matches(ln, '(?i)^sequenza degli eventi:?') AS smos_flow, regexp_matches(ln, '(?i)^condizione di entrata:?') AS eanci_entry, regexp_matches(ln, '(?i)^flusso di eventi:?') AS eanci_flow
FROM (SELECT doc_id, pre || regexp_replace(text, '(?s)\\n.*', '') AS ln FROM documents, (SELECT unnest(['', 'Use case name: ', 'ENTRY Tourist conditions', 'Requirement 12: ', 'Precondizioni ', 'Sequenza degli eventi:', 'Condizione di entrata:', 'Flusso di eventi']) AS pre) WHERE text IS NOT NULL)""")
def tok05(spark, d):
    """The templates of the projects on the first lines of all documents, as they are and behind headers of each project."""
    pre = ["", "Use case name: ", "ENTRY Tourist conditions", "Requirement 12: ", "Precondizioni ", "Sequenza degli eventi:", "Condizione di entrata:", "Flusso di eventi"]
    lines = load(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.array(*map(F.lit, pre))).alias("pre"), F.regexp_replace("text", "(?s)\n.*", "").alias("t"))
    has = lambda ds, section: F.concat("pre", "t").rlike("(?i)^" + DATASETS[ds].headers[section]).alias
    return lines.select(
        "doc_id", has("etour308", "name")("etour_name"), has("etour308", "precondition")("etour_entry"), has("libest", "name")("libest_name"), has("smos", "precondition")("smos_entry"), has("smos", "flow")("smos_flow"),
        has("eanci", "precondition")("eanci_entry"), has("eanci", "flow")("eanci_flow"),
    )


@query("tok05_sections", "SELECT * FROM (VALUES ('eanci', 'actor precondition postcondition quality flow name'), ('eanci_no_trans', 'actor precondition postcondition quality flow name'), ('etour308', 'name description actor precondition postcondition quality flow'), ('libest', 'name'), ('smos', 'name description actor precondition postcondition flow user system'), ('smos_trans', 'name description actor precondition postcondition flow user system')) v(dataset, x), LATERAL (SELECT unnest(string_split(x, ' ')) AS section)".replace("SELECT * FROM", "SELECT dataset, section FROM"))
def tok05_sections(spark, d):
    """The sections that each project's use cases have."""
    return spark.createDataFrame([(c.name, s) for c in DATASETS.values() for s in SECTIONS if s in c.headers], "dataset string, section string")


@query("snk05_rows_to_csv", f"SELECT dataset, count(*) AS n FROM {_LINKS} GROUP BY dataset")
def snk05(spark, d):
    """Rows at hand written as a CSV and read again."""
    p = _path(spark, "rows")
    S.write_csv(_links(spark, d).groupBy("dataset").agg(F.count("*").alias("n")), p, single=True)
    return R.csv(spark, p, "dataset string, n long")


@query("snk11_precision_at", f"WITH {D.TRACE_SQL}, {_RANK} SELECT tool || ' ' || req || ' ' || rank || ' ' || round(s / rank, 4)::DECIMAL(6, 4) AS value FROM rk WHERE rank <= 3")
def snk11(spark, d):
    """Precision at 1 to 3 of each ranking as lines of text, written and read again."""
    r = M.ranked(_hits(spark, d), ("tool", "req")).filter("rank <= 3")
    p = _path(spark, "precision")
    S.write_lines(r.select(F.concat_ws(" ", "tool", "req", F.col("rank").cast("string"), F.round("precision_at", 4).cast("decimal(6,4)").cast("string")).alias("value")), p)
    return spark.read.text(p)


@query("snk14_reset", f"SELECT count(*) AS n FROM {_LINKS}")
def snk14(spark, d):
    """An output directory of the engine that is written, emptied and written again holds the second result only."""
    p = _path(spark, "reset")
    S.write_json(_links(spark, d).limit(1), p)
    S.reset_directory(spark, p)
    S.write_json(_links(spark, d), p)
    return spark.read.schema("dataset string").json(p).agg(F.count("*").alias("n"))


# --- steps -----------------------------------------------------------------------------------------------------

_URLS = "regexp_replace(x, 'https?://[^ \\t\\n\\r\\f\\x0b]+|www\\.[^ \\t\\n\\r\\f\\x0b]+', '', 'g')"


def _without(t: str, words: list[str]) -> str:
    return f"list_filter({t}, lambda x: NOT list_contains({_lit(words)}, x))"


def _split_sql(t: str) -> str:
    return _CAMEL.format(t=_map(_LETTERS, _SPLIT.format(t=t)))


def _long(t: str) -> str:
    return f"list_filter({t}, lambda x: length(x) > 2)"


def _chain(name: str, source, view: str, key: str, cte: str, sql: str) -> None:
    query(f"fn18_chain_{name}", f"WITH {cte} SELECT {key}, array_to_string({sql}, ' ') AS tokens FROM {view}")(lambda spark, d: spread(source(spark, d)).select(key, F.array_join(T.CHAINS[name](F.col("t")), " ").alias("tokens")))


_TOKS, _IDS = (D.text_tokens, "toks", "doc_id", D.TOKENS_SQL), (D.identifiers, "ident", "method_id", D.IDENT_SQL)
for _name, _stop in (("req_en", T.ENGLISH_STOP_WORDS), ("req_it", T.ITALIAN_STOP_WORDS)):
    _chain(_name, *_TOKS, _long(_without(_map("lower(x)", _split_sql(_map(_URLS))), _stop)))
_chain("code_it", *_IDS, _long(_without(_map("lower(x)", _without(_split_sql("t"), T.ITALIAN_CODE_STOP_WORDS)), T.ITALIAN_STOP_WORDS)))
_chain("sentence", *_TOKS, "list_filter(" + _map("CASE WHEN x = '' OR regexp_matches(x, '[.!;?]$') THEN x ELSE x || '.' END", _map(f"regexp_replace(regexp_replace(x, '{_WS}', ' ', 'g'), '^ | $', '', 'g')", _map(_URLS))) + ", lambda x: x <> '')")


@query("fn17_pruned", f"WITH {D.IDENT_SQL}, w AS (SELECT method_id, list_filter({_map('lower(x)', _CAMEL.format(t='t'))}, lambda x: length(x) > 8) AS w FROM ident), k AS (SELECT c.class_name, w.method_id, w.w FROM w JOIN (SELECT method_id, any_value(class_name) AS class_name FROM code_method GROUP BY method_id) c USING (method_id) WHERE len(w.w) > 0) SELECT class_name, count(*) AS members, sum(len(w))::BIGINT AS tokens FROM k GROUP BY class_name")
def fn17(spark, d):
    """Members whose tokens are all gone after the steps are taken out, and classes without a member left with them."""
    m = D.identifiers(spark, d).select("method_id", T.pipeline(T.camel_case, T.lower_case, T.longer_than(8))(F.col("t")).alias("w"))
    c = load(spark, d, "code_method").select("method_id", "class_name").dropDuplicates(["method_id"])
    return features.pruned(m.join(c, "method_id"), "class_name", "w").groupBy("class_name").agg(F.count("*").alias("members"), F.sum(F.size("w")).alias("tokens"))


@query("fn21_left_trimmed_lines", f"SELECT doc_id, i - 1 AS pos, regexp_replace(s[i], '^{_WS}', '') AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))")
def fn21(spark, d):
    t = load(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(T.left_trimmed(F.split("text", "\n", -1))).alias("pos", "line"))
    return t.withColumn("pos", F.col("pos").cast("long"))


@query("flt08_same_class", f"{_PAIRS} SELECT DISTINCT caller, callee FROM cg WHERE caller // 20 = callee // 20")
def flt08(spark, d):
    """Calls within a class, elements of one file being those of one class."""
    return L.same_class(D.call_edges(spark, d), D.elem(spark, d).select(F.col("id").alias("elem"), F.col("file").alias("owner"))).distinct()


# --- embeddings from artefacts ---------------------------------------------------------------------------------


@query("emb01_directory_to_vectors", f"WITH {D.METHOD_SQL}, r AS (SELECT req_id AS file, lower(any_value(req_text)) AS t FROM issue_entry WHERE req_text IS NOT NULL GROUP BY req_id), w AS (SELECT file, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS word FROM r), x AS (SELECT file, unnest(vec) AS x, unnest(range(64)) AS i FROM w JOIN wv USING (word) WHERE length(word) > 2) SELECT file, i, round(avg(x), 6) AS x FROM x GROUP BY file, i")
def emb01(spark, d):
    """From a directory of requirement texts to their vectors: read, tokenised, put through the steps, looked up, averaged."""
    r = first_delivery(load(spark, d, "issue_entry").select("req_id", "req_text", "loaded_at"), "req_id").filter("req_text is not null")
    p = _path(spark, "requirements")
    S.write_lines(r.select(F.concat_ws(" ", F.col("req_id").cast("string"), F.regexp_replace(F.base64(F.encode("req_text", "UTF-8")), r"\s", "")).alias("value")), p)
    part = F.split("line", " ", 2)
    texts = R.lines(R.texts(spark, p, "*.txt")).filter("line <> ''").select(part[0].cast("long").alias("file"), F.unbase64(part[1]).cast("string").alias("text"))
    return _first_dims(features.artefact_vectors(texts, D.word_vec(spark, d), T.word_tokens, T.pipeline(T.lower_case, T.longer_than(2))), "file")


@query("emb11_name_sentences", "SELECT method_id, array_to_string(list_transform(regexp_extract_all(coalesce(c, ''), '[A-Z]?[a-z]+') || regexp_extract_all(coalesce(m, ''), '[A-Z]?[a-z]+'), lambda x: lower(x)), ' ') || '.' AS sentence FROM (SELECT method_id, any_value(class_name) AS c, any_value(method_name) AS m FROM code_method GROUP BY method_id)")
def emb11(spark, d):
    """Class and method words as one sentence, as it goes to a sentence model."""
    m = load(spark, d, "code_method").select("method_id", "class_name", "method_name").dropDuplicates(["method_id"])
    words = lambda c: F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("([A-Z]?[a-z]+)"), 1), F.lower)
    return m.select("method_id", features.name_sentence(words("class_name"), words("method_name")).alias("sentence"))


@query("emb12_tfidf_identifiers", f"WITH {D.METHOD_SQL}, {_TFIDF.format('mw')}, e AS (SELECT DISTINCT file, elem, word FROM mw), x AS (SELECT file, elem, weight, unnest(vec) AS x, unnest(range(64)) AS i FROM e JOIN wt USING (file, word) JOIN wv USING (word)), m AS (SELECT file, elem, i, sum(x * weight) / sum(weight) AS x FROM x GROUP BY ALL) SELECT file, i, round(avg(x), 6) AS x FROM m GROUP BY file, i")
def emb12(spark, d):
    """Classes as the mean of their methods' TF-IDF weighted means."""
    w = D.method_words(spark, d)
    each = features.weighted_word_mean(w, D.word_vec(spark, d), features.tfidf(w), ["file", "elem"])
    return _first_dims(V.mean_vector(each, ["file"], "vec"), "file")


@query("emb14_mock", f"WITH {D.IDENT_SQL} SELECT method_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM ident")
def emb14(spark, d):
    """The token structure passed through in place of vectors."""
    return features.mock_elements(D.identifiers(spark, d), "t").select("method_id", F.size("vec").cast("long").alias("n"), F.array_join("vec", " ").alias("tokens"))


# --- evaluation runs -------------------------------------------------------------------------------------------


@query("agg18_tuples", f"WITH {D.TRACE_SQL}, t AS (SELECT DISTINCT tool, req, code, hit FROM hits WHERE sim > 0.3) SELECT tool, {_PRF} FROM (SELECT tool, count(*) AS found, sum(hit)::BIGINT AS hits, (SELECT count(*) FROM gold) AS gold FROM t GROUP BY tool)")
def agg18(spark, d):
    """Links as bare (req, code) tuples, a set for each tool."""
    t = L.file_threshold(D.trace_scores(spark, d), F.lit(0.3)).select("tool", F.struct("req", "code").alias("link"))
    return _rounded(M.evaluate_tuples(t, D.trace_gold(spark, d), ("tool",)), "precision", "recall", "f1")


@query("swp05_all_similarities", f"{_PAIRS} SELECT elem, part, round(sim, 4) AS sim FROM pairs")
def swp05(spark, d):
    """A run that saves all similarities before any threshold, read again."""
    p = _path(spark, "similarities")
    D.pairs(spark, d).select("elem", "part", F.round("sim", 4).alias("sim")).write.parquet(S.output_path(p, "similarities", technique="cosine"))
    return spark.read.schema("elem long, part long, sim double").parquet(p + "/similarities/technique=cosine")


@query("swp06_strategies", f"WITH {D.TRACE_SQL}, {_SWEEP_F} SELECT 'recall_precision' AS strategy, tool, round(hits / gold, 6) AS x, round(max(hits / found), 6) AS y FROM cells GROUP BY tool, hits / gold UNION ALL SELECT 'best', tool, f, round(2 * hits / (found + gold), 6) FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY 2 * hits / (found + gold) DESC, f) AS r FROM cells) WHERE r = 1")
def swp06(spark, d):
    """One sweep, written by two strategies and read again."""
    p = _path(spark, "strategies")
    techniques.save_strategies(materialize(_cells(spark, d), "cells"), p, ("tool",))
    return _rounded(R.csv(spark, [f"{p}/recall_precision", f"{p}/best"], "strategy string, tool string, x double, y double"), "x", "y")


# --- labelled data ---------------------------------------------------------------------------------------------


@query("smp03_train_test", "SELECT part, count(*) AS n, sum(valid)::BIGINT AS valid FROM (SELECT CASE WHEN strpos('13579', right(regexp_replace(r.req, '[.]txt$', ''), 1)) > 0 THEN 'train' ELSE 'test' END AS part, CASE WHEN g.req IS NULL THEN 0 ELSE 1 END AS valid FROM (SELECT DISTINCT dataset, lower(req_filename) AS req FROM trace_link WHERE dataset IS NOT NULL AND req_filename IS NOT NULL AND code_filename IS NOT NULL) r JOIN (SELECT DISTINCT dataset, lower(code_filename) AS code FROM trace_link WHERE dataset IS NOT NULL AND req_filename IS NOT NULL AND code_filename IS NOT NULL) c USING (dataset) LEFT JOIN (SELECT DISTINCT dataset, lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link) g ON g.dataset = r.dataset AND g.req = r.req AND g.code = c.code) GROUP BY part")
def smp03(spark, d):
    """Labelled entries of the requirements in training and test CSVs, written and read again; requirements of odd number train."""
    t = _links(spark, d)
    g = materialize(t.select("dataset", F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code")).distinct(), "gold")
    part = F.when(F.regexp_replace("req", "[.]txt$", "").rlike("[13579]$"), "train").otherwise("test")
    r = g.select("dataset", "req").distinct().withColumn("requirement", F.concat_ws(" ", part, "req"))
    c = g.select("dataset", "code").distinct().withColumn("code_entry", T.stem(F.col("code")))
    p = _path(spark, "labelled")
    sampling.write_labelled(sampling.labelled_pairs(r, c, g).withColumn("part", F.substring_index("requirement", " ", 1)), p)
    return R.csv(spark, p, R.LABELLED).select(F.substring_index("requirement", " ", 1).alias("part"), "valid").groupBy("part").agg(F.count("*").alias("n"), F.sum("valid").alias("valid"))


@query("smp05_random_pairs", f"WITH {D.TRACE_SQL} SELECT req, code, 'pair' AS what FROM (SELECT * FROM gold ORDER BY md5(req || '|' || code || '|5'), req, code LIMIT 1) UNION ALL SELECT req, code, 'two' FROM (SELECT * FROM gold ORDER BY md5(req || '|' || code || '|6'), req, code LIMIT 2)")
def smp05(spark, d):
    """A repeatable random pair, element and two distinct elements of the gold set."""
    g = D.trace_gold(spark, d)
    one, two = sampling.random_rows(g, 1, 5), sampling.random_rows(g, 2, 6)
    return one.withColumn("what", F.lit("pair")).unionByName(two.withColumn("what", F.lit("two")))


@query("swp11_inheritance", "WITH f AS (SELECT file_id, any_value(class_name) AS class_name, any_value(file_name) AS file FROM code_file GROUP BY file_id), c AS (SELECT regexp_replace(file, '[.][^.]*$', '') AS class_name, arg_max(file, file_id) AS file FROM f WHERE file IS NOT NULL GROUP BY 1), s AS (SELECT file, regexp_replace(regexp_replace(file, '[.][^.]*$', ''), '_[0-9]+$', '') AS super_class FROM f WHERE regexp_matches(file, '_[0-9]+[.][^.]*$')) SELECT DISTINCT s.file AS sub, c.file AS super FROM s JOIN c ON c.class_name = s.super_class")
def swp11(spark, d):
    """Edges from files to the files of their super classes: a class with a number is derived from the one without it."""
    f = load(spark, d, "code_file").select("file_id", "file_name").filter("file_name is not null").distinct()
    files = graph.class_files(f.select(T.stem(F.col("file_name")).alias("class_name"), F.col("file_name").alias("file"), F.col("file_id").alias("ord")))
    declared = f.filter(F.col("file_name").rlike(r"_[0-9]+[.][^.]*$")).select(F.col("file_name").alias("file"), F.regexp_replace(T.stem(F.col("file_name")), "_[0-9]+$", "").alias("super_class"))
    return graph.inheritance_edges(declared, files)
