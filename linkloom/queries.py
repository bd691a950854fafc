"""Queries over the driver's tables for the engine's own operators, with their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import vectors as V
from linkloom.operators import evolve, features, graph, sampling, similarity
from linkloom.operators import links as L
from linkloom.operators import metrics as M
from linkloom.operators.code_parser import parse_sources
from linkloom.plans import domain as D
from linkloom.plans import techniques
from linkloom.plans.datasets import PROJECT_HEADERS, any_language
from linkloom.runtime import first_delivery, load, materialize, own_dir, spread
from linkloom.sources import readers as R
from linkloom.sources import writers as S

Query = Callable[[SparkSession, str], DataFrame]
HEADERS = any_language(PROJECT_HEADERS)
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- token functions -------------------------------------------------------------------------------------------


def _tokens(name: str, view: str, step: T.Step, sql: str) -> None:
    """A step over the tokens of all identifiers or all texts; sql is the twin over the list t."""
    source, key, cte = (D.identifiers, "method_id", D.IDENT_SQL) if view == "ident" else (D.text_tokens, "doc_id", D.TOKENS_SQL)
    query(name, f"WITH {cte} SELECT {key}, array_to_string({sql}, ' ') AS tokens FROM {view}")(lambda spark, d: spread(source(spark, d)).select(key, F.array_join(step(F.col("t")), " ").alias("tokens")))


def _map(expr: str, t: str = "t") -> str:
    return f"list_transform({t}, lambda x: {expr})"


def _lit(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


_CAMEL = "list_filter(flatten(list_transform({t}, lambda x: string_split_regex(regexp_replace(regexp_replace(x, '([A-Z]+)', ' \\1', 'g'), '([A-Z][a-z]+)', ' \\1', 'g'), '\\s+'))), lambda x: x <> '')"
_SPLIT = "flatten(list_transform({t}, lambda x: string_split_regex(x, '[/._]')))"
_WS = "[ \\t\\n\\r\\f\\x0b]+"
_CODE_CHAIN = "list_filter(list_filter({t}, lambda x: NOT list_contains(" + _lit(T.ENGLISH_STOP_WORDS) + ", x)), lambda x: length(x) > 2)"
_LETTERS = "regexp_replace(x, '[^a-zA-Z -]', '', 'g')"
_tokens("fn01_camel", "ident", T.camel_case, _CAMEL.format(t="t"))
_tokens("fn02_separator", "ident", T.separate, _SPLIT.format(t="t"))
_tokens("fn03_lower", "ident", T.lower_case, _map("lower(x)"))
_tokens("fn04_nonletter", "toks", T.letters_only, _map(_LETTERS))
_tokens("fn05_url", "toks", T.no_urls, _map("regexp_replace(x, 'https?://[^ \\t\\n\\r\\f\\x0b]+|www\\.[^ \\t\\n\\r\\f\\x0b]+', '', 'g')"))
_tokens("fn06_stopwords", "toks", T.stop_words(T.ENGLISH_STOP_WORDS), f"list_filter(t, lambda x: NOT list_contains({_lit(T.ENGLISH_STOP_WORDS)}, x))")
_tokens("fn07_code_stopwords", "ident", T.stop_words(T.CODE_STOP_WORDS), f"list_filter(t, lambda x: NOT list_contains({_lit(T.CODE_STOP_WORDS)}, x))")
_tokens("fn09_token_filter", "toks", T.keep(lambda x: x.startswith("r")), "list_filter(t, lambda x: starts_with(x, 'r'))")
_tokens("fn11_javadoc_filter", "toks", T.javadoc_filter, f"list_filter(flatten(list_transform(list_filter(t, lambda x: NOT regexp_matches(x, '(?i)@(throws|author|version)')), lambda x: string_split_regex(regexp_replace(x, '(?i)@(param|return|link)', '', 'g'), '{_WS}'))), lambda x: x <> '')")
_tokens("fn12_white_space", "toks", T.one_space, _map(f"regexp_replace(regexp_replace(x, '{_WS}', ' ', 'g'), '^ | $', '', 'g')"))
_tokens("fn13_fullstop", "toks", T.full_stop, _map("CASE WHEN x = '' OR regexp_matches(x, '[.!;?]$') THEN x ELSE x || '.' END"))
_tokens("fn14_last_mark", "ident", T.no_last_mark, _map("regexp_replace(x, '[.!;?]$', '')"))
_tokens("fn15_length", "ident", T.longer_than(8), "list_filter(t, lambda x: length(x) > 8)")
_tokens("fn16_empty", "ident", T.drop_empty, "list_filter(t, lambda x: x <> '')")
_tokens("fn18_chain_code_en", "ident", T.CHAINS["code_en"], _CODE_CHAIN.format(t=_map("lower(x)", f"list_filter({_CAMEL.format(t=_map(_LETTERS, _SPLIT.format(t='t')))}, lambda x: NOT list_contains({_lit(T.CODE_STOP_WORDS)}, x))")))


@query("fn08_tfidf_filter", f"WITH {D.WORDS_SQL}, tf AS (SELECT file, word, count(*) AS c FROM dw WHERE length(word) >= 2 GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT file, word, c * (ln((1 + (SELECT count(DISTINCT file) FROM tf)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (word)), wt AS (SELECT file, word, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS weight FROM raw) SELECT file, count(*) AS kept FROM dw JOIN wt USING (file, word) WHERE weight > 0.123456 GROUP BY file")
def fn08(spark, d):
    t = materialize(D.doc_words(spark, d), "tokens")
    return features.tfidf_filter(t, features.tfidf(t), 0.123456).groupBy("file").agg(F.count("*").alias("kept"))


@query("fn10_lemmas", f"WITH {D.METHOD_SQL}, v AS (SELECT DISTINCT word FROM mw), rules AS (SELECT unnest(['s', 'ses', 'ves', 'xes', 'zes', 'ches', 'shes', 'men', 'ies']) AS a, unnest(['', 's', 'f', 'x', 'z', 'ch', 'sh', 'man', 'y']) AS b), base AS (SELECT word, word AS form FROM v UNION SELECT word, left(word, length(word) - length(a)) || b FROM v, rules WHERE ends_with(word, a)), lem AS (SELECT word, form AS lemma FROM (SELECT base.word, form, row_number() OVER (PARTITION BY base.word ORDER BY length(form), form) AS r FROM base JOIN v x ON x.word = form) WHERE r = 1) SELECT lemma, count(*) AS n FROM mw JOIN lem USING (word) GROUP BY lemma")
def fn10(spark, d):
    """Lemmas by ending rules and a lexicon, here the words of the table themselves."""
    w = materialize(D.method_words(spark, d).groupBy("word").agg(F.count("*").alias("c")), "words")
    return w.join(features.noun_lemmas(w.select("word"), w.select("word")), "word").groupBy("lemma").agg(F.sum("c").alias("n"))


@query("fn19_paths", "SELECT file_id, list_last(string_split_regex(p, '[/\\\\]')) AS file_name, regexp_replace(list_last(string_split_regex(p, '[/\\\\]')), '\\.[^.]*$', '') || '.txt' AS renamed FROM (SELECT file_id, any_value(file_path) AS p FROM code_file GROUP BY file_id)")
def fn19(spark, d):
    f = load(spark, d, "code_file").select("file_id", "file_path").distinct()
    return f.select("file_id", T.file_name(F.col("file_path")).alias("file_name"), T.with_extension(T.file_name(F.col("file_path")), "txt").alias("renamed"))


@query("fn20_call_keys", "SELECT method_id, any_value(class_name) || '.' || any_value(method_name) || '(' || array_to_string(list_transform(coalesce(any_value(params), []), lambda x: regexp_replace(regexp_replace(x, '<.*>|\\s', '', 'g'), '^.*\\.', '')), ',') || ')' AS key FROM code_method GROUP BY method_id")
def fn20(spark, d):
    m = load(spark, d, "code_method").select("method_id", "class_name", "method_name", "params").dropDuplicates(["method_id"])
    return m.select("method_id", T.call_key(F.col("method_name"), F.coalesce("params", F.array().cast("array<string>")), F.col("class_name")).alias("key"))


# --- tokenizers ------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all({0}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\t\\n\\r\\f\\x0b \\p{{L}}\\p{{M}}\\p{{N}}]')"


@query("tok01_words", f"SELECT doc_id, len({_TOK.format('text')}) AS n, array_to_string({_TOK.format('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def tok01(spark, d):
    t = load(spark, d, "documents").filter("text is not null").select("doc_id", T.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("tok01_words_italian", f"SELECT doc_id, len({_TOK.format(chr(34) + 'x' + chr(34))}) AS n FROM (SELECT doc_id, regexp_replace(text, '''', ''' ', 'g') AS x FROM documents WHERE lower(lang) = 'it' AND text IS NOT NULL)")
def tok01_it(spark, d):
    return load(spark, d, "documents").filter("lower(lang) = 'it' and text is not null").select("doc_id", F.size(T.word_tokens(F.col("text"), italian=True)).cast("long").alias("n"))


_SENT = "list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0b]+([^\\p{Ll} \\t\\n\\r\\f\\x0b])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_matches(x, '[^\\t\\n\\x0b\\f\\r\\p{Z}]'))"


@query("tok02_sentences", f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, {_SENT} AS s, unnest(range(1, len({_SENT}) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
def tok02(spark, d):
    return load(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("tok03_words_by_sentence", f"SELECT doc_id, len(s) AS sentences, list_sum(list_transform(s, lambda x: len({_TOK.format('x')})))::BIGINT AS words FROM (SELECT doc_id, {_SENT} AS s FROM documents WHERE text IS NOT NULL) WHERE len(s) > 0")
def tok03(spark, d):
    t = load(spark, d, "documents").filter("text is not null").select("doc_id", T.words_by_sentence(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return t.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size(F.flatten("s")).cast("long").alias("words"))


def _headers_sql(h: dict[str, str], col: str = "line") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i)^{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in reversed(h.items())) + " END"


@query("tok04_usecase_sections", f"""
WITH ln AS (SELECT doc_id AS file, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE artefact_kind = 'use_case' AND text IS NOT NULL))),
tg AS (SELECT *, {_headers_sql(HEADERS)} AS tag FROM ln)
SELECT file, section, count(*) AS lines FROM (SELECT file, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING), 'description') AS section FROM tg) GROUP BY file, section""")
def tok04(spark, d):
    docs = load(spark, d, "documents").filter("artefact_kind = 'use_case' and text is not null")
    lines = docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return graph.use_case_sections(lines, HEADERS).groupBy("file", "section").agg(F.count("*").alias("lines"))


@query("tok06_javadoc", "SELECT file_id, i - 1 AS pos, regexp_replace(c[i], '(?is)@(param|throws|author|version|return).*$', '') AS description FROM (SELECT file_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT file_id, regexp_extract_all(any_value(content), '(?s)/\\*\\*.*?\\*/') AS c FROM code_file GROUP BY file_id))")
def tok06(spark, d):
    f = first_delivery(load(spark, d, "code_file").select("file_id", "content", "loaded_at"), "file_id")
    c = f.select("file_id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)(/\*\*.*?\*/)"), 1)).alias("pos", "c"))
    return c.select("file_id", F.col("pos").cast("long").alias("pos"), T.javadoc_description(F.col("c")).alias("description"))


def _parsed(spark, d):
    f = first_delivery(load(spark, d, "code_file").select("file_id", "file_name", "content", "loaded_at"), "file_id")
    return parse_sources(f.select(F.concat_ws("/", F.col("file_id").cast("string"), "file_name").alias("file"), "content"))


@query("tok07_declarations")
def tok07(spark, d):
    return _parsed(spark, d).select("file", "ord", "kind", "class_path", "name", "type", F.array_join("params", ",").alias("params"), F.array_join("supers", ",").alias("supers"), "line")


@query("tok08_c_declarations")
def tok08(spark, d):
    return _parsed(spark, d).filter(F.col("file").rlike(r"\.[ch]$")).select("file", "ord", "kind", "name", "type", F.array_join("params", ",").alias("params"))


@query("tok11_left_sides")
def tok11(spark, d):
    return _parsed(spark, d).filter(F.size("left_side") > 0).select("file", "ord", "name", F.array_join("left_side", " ").alias("left_side"))


_DEF = "^ *(?:public .*|[A-Za-z_][A-Za-z_0-9 *]*[(][^;]*[)] *)[{]$"


@query("tok09_comment_owner", f"""
WITH ln AS (SELECT file_id AS file, i AS line, s[i] AS t FROM (SELECT file_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT file_id, string_split(replace(any_value(content), chr(13), ''), chr(10)) AS s FROM code_file WHERE file_name LIKE '%.java' OR file_name LIKE '%.c' GROUP BY file_id))),
def AS (SELECT file, line, t AS definition, contains(t, 'class ') AS is_enum FROM ln WHERE regexp_matches(t, '{_DEF}')),
blk AS (SELECT *, sum(CASE WHEN regexp_matches(t, '^ */[*]') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS g FROM ln),
fin AS (SELECT file, g, min(line) AS first, min(line) FILTER (WHERE contains(t, '*/')) AS last FROM blk WHERE g > 0 GROUP BY file, g),
com AS (SELECT file, first AS line, last AS end_line, string_agg(t, chr(10) ORDER BY b.line) AS comment FROM blk b JOIN fin USING (file, g) WHERE b.line <= last GROUP BY file, first, last),
direct AS (SELECT c.file, c.comment, c.line, f.definition FROM com c JOIN def f ON f.file = c.file AND f.line = c.end_line + 1),
above AS (SELECT c.file, c.comment, c.line, f.definition, f.is_enum FROM (SELECT c.* FROM com c WHERE NOT EXISTS (SELECT 1 FROM def f WHERE f.file = c.file AND f.line = c.end_line + 1)) c ASOF JOIN def f ON f.file = c.file AND c.line >= f.line)
SELECT * FROM direct UNION ALL SELECT file, comment, line, definition FROM above WHERE NOT is_enum""")
def tok09(spark, d):
    """Block comments of one or more lines of Java and C sources, each with the definition it belongs to."""
    f = first_delivery(load(spark, d, "code_file").select("file_id", "file_name", "content", "loaded_at").filter("file_name like '%.java' or file_name like '%.c'"), "file_id")
    ln = f.select(F.col("file_id").alias("file"), F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n", -1)).alias("p", "t")).select("file", (F.col("p") + 1).cast("long").alias("line"), "t")
    defs = ln.filter(F.col("t").rlike(_DEF)).select("file", "line", F.col("t").alias("definition"), F.col("t").contains("class ").alias("is_enum"))
    return graph.nearest_definition(graph.block_comments(ln), defs)


@query("tok10_array_suffix", "SELECT p_partkey, p_type || repeat('[]', p_size % 3) AS t FROM part")
def tok10(spark, d):
    return load(spark, d, "part").select("p_partkey", T.array_suffix(F.col("p_type"), (F.col("p_size") % 3).cast("int")).alias("t"))


@query("tok12_chosen_words", f"WITH {D.IDENT_SQL} SELECT method_id, array_to_string(t[1:2], ' ') AS words FROM ident")
def tok12(spark, d):
    t = D.identifiers(spark, d)
    return t.select("method_id", F.array_join(T.choose_words({"class": F.slice("t", 1, 1), "method": F.slice("t", 2, 1), "params": F.slice("t", 3, 100)}, ["class", "method"]), " ").alias("words"))


@query("tok13_comments_by_class")
def tok13(spark, d):
    return _parsed(spark, d).groupBy("file").agg(F.sum(F.when(F.col("comment") != "", 1).otherwise(0)).alias("comments"), F.sum(F.when(F.col("kind") == "method", 1).otherwise(0)).alias("methods"), F.sum(F.size("left_side")).alias("left_sides"))


# --- numbers and vectors ---------------------------------------------------------------------------------------

_PAIRS = f"WITH {D.SQL}"


@query("num01_cosine", f"{_PAIRS} SELECT elem, part, round(sim, 6) AS sim FROM pairs")
def num01(spark, d):
    return D.pairs(spark, d).select("elem", "part", F.round("sim", 6).alias("sim"))


@query("num02_mean_vector", f"{_PAIRS}, x AS (SELECT code, unnest(vec) AS x, unnest(range(64)) AS i FROM code_el) SELECT code, i, round(avg(x), 6) AS x FROM x GROUP BY code, i")
def num02(spark, d):
    m = V.mean_vector(D.code_elements(spark, d), ["code"], "vec")
    return m.select("code", F.posexplode("vec").alias("i", "x")).select("code", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("num03_weighted_mean", f"{_PAIRS}, x AS (SELECT code, elem % 7 + 1 AS w, unnest(vec) AS x, unnest(range(64)) AS i FROM code_el) SELECT code, i, round(sum(x * w) / sum(w), 6) AS x FROM x GROUP BY code, i")
def num03(spark, d):
    m = V.mean_vector(D.code_elements(spark, d).withColumn("w", F.col("elem") % 7 + 1), ["code"], "vec", "w")
    return m.select("code", F.posexplode("vec").alias("i", "x")).select("code", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("num04_map_range", "SELECT p_partkey, round((p_retailprice - 900) / (2100 - 900), 6) AS v FROM part")
def num04(spark, d):
    return load(spark, d, "part").select("p_partkey", F.round(V.min_max(F.col("p_retailprice"), 900, 2100), 6).alias("v"))


@query("num05_minmax", f"WITH {D.TRACE_SQL} SELECT tool, req, code, round((sim - min(sim) OVER (PARTITION BY tool)) / (max(sim) OVER (PARTITION BY tool) - min(sim) OVER (PARTITION BY tool)), 6) AS sim FROM scores")
def num05(spark, d):
    return L.normalise(D.trace_scores(spark, d), ("tool",)).select("tool", "req", "code", F.round("sim", 6).alias("sim"))


@query("num06_range", "SELECT round(0.2 + i * 0.05, 2)::DOUBLE AS t FROM range(13) r(i)")
def num06(spark, d):
    return V.threshold_range(spark, 0.2, 0.8, 0.05)


@query("num07_top_percent", "SELECT n_nationkey::BIGINT AS n, round_even(n_nationkey * 0.1, 0)::BIGINT AS k FROM nation")
def num07(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    return n.select("n", V.top_percent(F.col("n"), 0.1).alias("k"))


@query("num08_complement", "SELECT n_nationkey, round_even(1 - n_nationkey / 30, 2) AS c FROM nation")
def num08(spark, d):
    return load(spark, d, "nation").select("n_nationkey", V.complement(F.col("n_nationkey") / 30).alias("c"))


@query("num09_jaccard", "WITH m AS (SELECT method_id, list_distinct(list_transform(regexp_extract_all(any_value(class_name), '[A-Z]?[a-z]+'), lambda x: lower(x))) AS a, list_distinct(list_transform(regexp_extract_all(any_value(method_name), '[A-Z]?[a-z]+'), lambda x: lower(x))) AS b FROM code_method GROUP BY method_id) SELECT method_id, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS sim FROM (SELECT method_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM m)")
def num09(spark, d):
    """The words of a method's class against those of its own name."""
    m = load(spark, d, "code_method").select("method_id", "class_name", "method_name").dropDuplicates(["method_id"])
    words = lambda c: F.coalesce(F.transform(F.regexp_extract_all(c, F.lit("([A-Z]?[a-z]+)"), 1), F.lower), F.array().cast("array<string>"))
    return m.select("method_id", F.round(V.jaccard(words("class_name"), words("method_name")), 6).alias("sim"))


@query("num11_subword", "WITH w AS (SELECT DISTINCT p_brand AS word FROM part), g AS (SELECT word, '<' || word || '>' AS x, unnest([3, 4, 5, 6]) AS n FROM w), h AS (SELECT word, substr(x, i, n) AS gram FROM (SELECT word, x, n, unnest(range(1, length(x) - n + 2)) AS i FROM g)), v AS (SELECT word, gram, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM h JOIN embeddings ON vec_id = (ascii(gram) * 31 + length(gram) + ascii(reverse(gram)) * 7) % (SELECT count(*) FROM embeddings)) SELECT word, i, round(avg(x), 6) AS x FROM v GROUP BY word, i")
def num11(spark, d):
    words = load(spark, d, "part").select(F.col("p_brand").alias("word")).distinct()
    w = F.concat(F.lit("<"), "word", F.lit(">"))
    grams = words.select(F.explode(F.array(*(F.lit(n) for n in (3, 4, 5, 6)))).alias("n"), w.alias("x")).filter("length(x) >= n").select(F.explode(F.expr("transform(sequence(1, length(x) - n + 1), i -> substring(x, i, n))")).alias("word")).distinct()
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = e.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    vecs = grams.withColumn("k", F.lit(1)).join(F.broadcast(n), "k").withColumn("vec_id", (F.ascii("word") * 31 + F.length("word") + F.ascii(F.reverse("word")) * 7).cast("long") % F.col("n")).join(e, "vec_id").select("word", "vec")
    out = similarity.subword_vectors(words, vecs, 64)
    return out.select("word", F.posexplode("vec").alias("i", "x")).select("word", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("num12_reduce", f"{_PAIRS} SELECT code, req, round(max(sim), 6) AS mx, round(min(sim), 6) AS mn, round(avg(sim), 6) AS mean FROM pairs GROUP BY code, req")
def num12(spark, d):
    p = D.pairs(spark, d).groupBy("code", "req")
    return p.agg(*(F.round(V.reduce_by(h)("sim"), 6).alias(a) for h, a in (("max", "mx"), ("min", "mn"), ("mean", "mean"))))


@query("num13_mock_vectors", f"WITH {D.METHOD_SQL}, h AS (SELECT word, i, md5(word || '|' || i) AS h FROM (SELECT DISTINCT word FROM mw), (SELECT unnest(range(1, 17)) AS i)) SELECT word, i - 1 AS i, round(((((strpos('0123456789abcdef', h[1]) - 1) * 16 + strpos('0123456789abcdef', h[2]) - 1) * 16 + strpos('0123456789abcdef', h[3]) - 1) * 16 + strpos('0123456789abcdef', h[4]) - 1) % 2001 - 1000, 0) / 1000 AS x FROM h")
def num13(spark, d):
    return _first_dims(similarity.hashed_vectors(D.method_words(spark, d), 16), "word")


def _wmd_inputs(spark, d):
    """All methods (a), the requirements whose id is divisible by 20 as queries (b), and the vectors of their words."""
    a = materialize(D.method_words(spark, d).select(F.col("elem").alias("a"), "word"), "method-words")
    b = materialize(D.part_words(spark, d).filter("part % 20 = 0").select(F.col("part").alias("b"), "word"), "part-words")
    return a, b, materialize(D.vectors_of(a.select("word").union(b.select("word")).distinct(), spark, d), "word-vectors")


_WMD_SQL = f"""WITH {D.METHOD_SQL}, a AS (SELECT elem AS a, word FROM mw), b AS (SELECT req_id AS b, unnest(regexp_extract_all(lower(any_value(req_text)), '[\\p{{L}}\\p{{N}}]+')) AS word FROM issue_entry WHERE req_id % 20 = 0 AND req_text IS NOT NULL GROUP BY req_id),
w AS (SELECT word, embedding::DOUBLE[] AS vec FROM (SELECT DISTINCT word, (ascii(word) * 31 + length(word) * 7 + ascii(reverse(word)) * 13) % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT word FROM a UNION SELECT word FROM b)) JOIN embeddings USING (vec_id) WHERE vec_id % 11 <> 0),
wa AS (SELECT DISTINCT word FROM a), wb AS (SELECT DISTINCT word FROM b), dist AS (SELECT x.word AS p, y.word AS q, list_distance(v.vec, u.vec) AS d FROM wa x JOIN w v ON v.word = x.word, wb y JOIN w u ON u.word = y.word),
ca AS (SELECT a, word, count(*) AS n FROM a JOIN w USING (word) GROUP BY ALL), cb AS (SELECT b, word, count(*) AS n FROM b JOIN w USING (word) GROUP BY ALL),
there AS (SELECT a.a, m.b, sum(m.d * a.n) / sum(a.n) AS c FROM ca a JOIN (SELECT p, b, min(d) AS d FROM dist JOIN cb ON cb.word = q GROUP BY p, b) m ON m.p = a.word GROUP BY a.a, m.b),
back AS (SELECT m.a, b.b, sum(m.d * b.n) / sum(b.n) AS c FROM cb b JOIN (SELECT q, a, min(d) AS d FROM dist JOIN ca ON ca.word = p GROUP BY q, a) m ON m.q = b.word GROUP BY m.a, b.b)
SELECT a, b, round(greatest(t.c, k.c), 6) AS rwmd FROM there t JOIN back k USING (a, b)"""


@query("num10_relaxed_wmd", _WMD_SQL)
def num10r(spark, d):
    """Relaxed distances of all methods to the queries; pairs in which a side has no known word have none."""
    a, b, vec = _wmd_inputs(spark, d)
    return similarity.wmd_all(a, b, vec).filter("rwmd < double('inf')").select("a", "b", F.round("rwmd", 6).alias("rwmd"))


@query("num10_exact_wmd")
def num10(spark, d):
    """For each query the ten nearest methods by the exact distance; the relaxed one, which is never larger, leaves out what can't be among them."""
    a, b, vec = _wmd_inputs(spark, d)
    return similarity.nearest_by_wmd(a, b, vec, 10).select("b", "rank", "a", F.round("wmd", 6).alias("wmd"))


# --- features --------------------------------------------------------------------------------------------------

_MEAN_W = f"WITH {D.METHOD_SQL}, x AS (SELECT file, elem, word, unnest(vec) AS x, unnest(range(64)) AS i FROM mw JOIN wv USING (word))"


def _first_dims(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vec").alias("i", "x")).select(*keys, F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("emb02_lookup", f"WITH {D.METHOD_SQL} SELECT elem, word, round(vec[1], 6) AS x FROM mw JOIN wv USING (word)")
def emb02(spark, d):
    return features.lookup(D.method_words(spark, d), D.word_vec(spark, d), ["elem"]).select("elem", "word", F.round(F.element_at("vec", 1), 6).alias("x"))


@query("emb03_word_mean", f"{_MEAN_W} SELECT file, i, round(avg(x), 6) AS x FROM x GROUP BY file, i")
def emb03(spark, d):
    return _first_dims(features.word_mean(D.method_words(spark, d), D.word_vec(spark, d), ["file"]), "file")


@query("emb04_mean_of_means", f"{_MEAN_W}, s AS (SELECT file, elem, i, avg(x) AS x FROM x GROUP BY file, elem, i) SELECT file, i, round(avg(x), 6) AS x FROM s GROUP BY file, i")
def emb04(spark, d):
    return _first_dims(features.mean_of_means(D.method_words(spark, d), D.word_vec(spark, d), ["file", "elem"], ["file"]), "file")


def _letter_model():
    """A stand-in for a sentence model: shares of letters. Real models are passed in the same way."""
    return lambda texts: [[t.lower().count(c) / max(len(t), 1) for c in "abcdefghijklmnop"] for t in texts]


@query("emb05_model_sentences", f"WITH s AS (SELECT doc_id, unnest({_SENT}) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(avg((length(s) - length(replace(replace(s, 'e', ''), 'E', ''))) / length(s)), 6) AS e FROM s GROUP BY doc_id")
def emb05(spark, d):
    s = load(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("text"))
    m = V.mean_vector(similarity.model_vectors(spread(s), _letter_model), ["doc_id"], "vec")
    return m.select("doc_id", F.round(F.element_at("vec", 5), 6).alias("e"))


@query("emb06_use_case_parts", f"""
WITH {D.METHOD_SQL}, ln AS (SELECT doc_id AS file, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE artefact_kind = 'use_case' AND text IS NOT NULL))),
sec AS (SELECT file, line, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING), 'description') AS section FROM (SELECT *, {_headers_sql(HEADERS)} AS tag FROM ln)),
w AS (SELECT file, section, lower(unnest(regexp_extract_all(line, '[A-Za-z]+'))) AS word FROM sec WHERE section IN ('name', 'flow')),
p AS (SELECT file, section, avg(vec[1]) AS x FROM w JOIN wv USING (word) GROUP BY ALL) SELECT file, round(avg(x), 6) AS x FROM p GROUP BY file""")
def emb06(spark, d):
    docs = load(spark, d, "documents").filter("artefact_kind = 'use_case' and text is not null")
    lines = docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    tagged = graph.use_case_sections(lines, {k: f"(?={v})" for k, v in HEADERS.items()}).filter("section in ('name', 'flow')")
    w = tagged.select("file", "section", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("word")).withColumn("word", F.lower("word"))
    out = features.mean_of_means(w, D.word_vec(spark, d), ["file", "section"], ["file"])
    return out.select("file", F.round(F.element_at("vec", 1), 6).alias("x"))


@query("emb10_distinct_words", f"{_MEAN_W}, s AS (SELECT DISTINCT file, word, i, x FROM x) SELECT file, i, round(avg(x), 6) AS x FROM s GROUP BY file, i")
def emb10(spark, d):
    return _first_dims(features.word_mean(D.method_words(spark, d), D.word_vec(spark, d), ["file"], distinct=True), "file")


_TFIDF = "tf AS (SELECT file, word, count(*) AS c FROM {0} WHERE length(word) >= 2 GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT file, word, c * (ln((1 + (SELECT count(DISTINCT file) FROM tf)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (word)), wt AS (SELECT file, word, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS weight FROM raw)"


@query("emb07_tfidf_mean", f"WITH {D.METHOD_SQL}, {_TFIDF.format('mw')}, x AS (SELECT file, weight, unnest(vec) AS x, unnest(range(64)) AS i FROM wt JOIN wv USING (word)) SELECT file, i, round(sum(x * weight) / sum(weight), 6) AS x FROM x GROUP BY file, i")
def emb07(spark, d):
    w = D.method_words(spark, d)
    return _first_dims(features.weighted_word_mean(w, D.word_vec(spark, d), features.tfidf(w), ["file"]), "file")


@query("emb13_class_voter", f"{_PAIRS} SELECT code, elem FROM code_el WHERE code % 3 <> 0 UNION ALL SELECT file, -file - 1 FROM files WHERE file % 3 = 0")
def emb13(spark, d):
    methods = D.code_elements(spark, d).filter("code % 3 <> 0")
    names = D.elem(spark, d).groupBy(F.col("file").alias("code")).agg(F.first("vec").alias("vec")).select("code", (-F.col("code") - 1).alias("elem"), "vec")
    return features.voters(methods, names, "optional").select("code", "elem")


@query("emb15_tfidf", f"WITH {D.WORDS_SQL}, {_TFIDF.format('dw')} SELECT file, word, round(weight, 6) AS weight FROM wt")
def emb15(spark, d):
    return features.tfidf(D.doc_words(spark, d)).select("file", "word", F.round("weight", 6).alias("weight"))


_REQ_WORDS = "rw AS (SELECT 'r' || req_id AS file, unnest(regexp_extract_all(lower(any_value(req_text)), '[\\p{L}\\p{N}]+')) AS word FROM issue_entry WHERE req_id % 20 = 0 AND req_text IS NOT NULL GROUP BY req_id), cw AS (SELECT 'c' || file AS file, word FROM mw), aw AS (SELECT * FROM rw UNION ALL SELECT * FROM cw)"


def _req_words(spark, d):
    """Words of the requirements whose id is divisible by 20, the queries of the search."""
    return D.part_words(spark, d).filter("part % 20 = 0").select(F.concat(F.lit("r"), F.col("part").cast("string")).alias("file"), "word")


def _class_words(spark, d):
    return D.method_words(spark, d).select(F.concat(F.lit("c"), "file").alias("file"), "word")


@query("emb16_tfidf_cosine", f"WITH {D.METHOD_SQL}, {_REQ_WORDS}, {_TFIDF.format('aw')} SELECT p.file AS a, q.file AS b, round(sum(p.weight * q.weight), 6) AS sim FROM wt p JOIN wt q ON p.word = q.word AND p.file LIKE 'r%' AND q.file LIKE 'c%' GROUP BY 1, 2")
def emb16(spark, d):
    """Requirements (queries) against all classes over a shared vocabulary."""
    w = materialize(features.tfidf(_req_words(spark, d).unionByName(_class_words(spark, d))), "tfidf")
    return features.sparse_cosine(w.filter("file like 'r%'"), w.filter("file like 'c%'")).select("a", "b", F.round("sim", 6).alias("sim"))


@query("emb17_jaccard", f"WITH {D.METHOD_SQL}, {_REQ_WORDS}, x AS (SELECT DISTINCT file, word FROM aw), n AS (SELECT file, count(*) AS n FROM x GROUP BY 1), c AS (SELECT p.file AS a, q.file AS b, count(*) AS c FROM x p JOIN x q ON p.word = q.word AND p.file LIKE 'r%' AND q.file LIKE 'c%' GROUP BY 1, 2) SELECT a, b, round(c / (m.n + k.n - c), 6) AS sim FROM c JOIN n m ON m.file = a JOIN n k ON k.file = b")
def emb17(spark, d):
    return features.sparse_jaccard(_req_words(spark, d).withColumnRenamed("file", "a"), _class_words(spark, d).withColumnRenamed("file", "b")).select("a", "b", F.round("sim", 6).alias("sim"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("jn01_pairs", f"{_PAIRS} SELECT code, req, count(*) AS n, round(sum(sim), 6) AS total FROM pairs GROUP BY code, req")
def jn01(spark, d):
    return D.pairs(spark, d).groupBy("code", "req").agg(F.count("*").alias("n"), F.round(F.sum("sim"), 6).alias("total"))


@query("jn02_file_pairs", f"{_PAIRS}, x AS (SELECT file, is_req, unnest(vec) AS x, unnest(range(64)) AS i FROM elem), m AS (SELECT file, is_req, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT file, is_req, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL) SELECT a.file AS code, b.file AS req, round(sum(a.x * b.x) / any_value(p.n * q.n), 6) AS sim FROM m a JOIN m b ON a.i = b.i AND NOT a.is_req AND b.is_req JOIN n p ON p.file = a.file AND NOT p.is_req JOIN n q ON q.file = b.file AND q.is_req GROUP BY 1, 2")
def jn02(spark, d):
    c = V.mean_vector(D.code_elements(spark, d), ["code"], "vec").withColumn("elem", F.col("code"))
    r = V.mean_vector(D.req_parts(spark, d), ["req"], "vec").withColumn("part", F.col("req"))
    return similarity.cosine_pairs(c, r).select("code", "req", F.round("sim", 6).alias("sim"))


@query("jn03_whole_requirement", f"{_PAIRS}, x AS (SELECT req, unnest(vec) AS x, unnest(range(64)) AS i FROM req_el), m AS (SELECT req, list(x ORDER BY i) AS vec FROM (SELECT req, i, avg(x) AS x FROM x GROUP BY ALL) GROUP BY req) SELECT elem, req, round(list_dot_product(c.vec, m.vec) / sqrt(list_dot_product(c.vec, c.vec) * list_dot_product(m.vec, m.vec)), 6) AS sim FROM code_el c, m")
def jn03(spark, d):
    """Methods against whole requirements, the mean of their parts."""
    r = V.mean_vector(D.req_parts(spark, d), ["req"], "vec").withColumn("part", F.col("req"))
    return similarity.cosine_pairs(D.code_elements(spark, d), r).select("elem", "req", F.round("sim", 6).alias("sim"))


@query("jn05_combination", f"{_PAIRS}, a AS (SELECT code, count(*) AS ids FROM pairs WHERE sim > 0.2 GROUP BY code), b AS (SELECT code, count(*) AS comments FROM pairs WHERE sim > 0.35 GROUP BY code) SELECT code, ids, coalesce(comments, 0) AS comments FROM a LEFT JOIN b USING (code)")
def jn05(spark, d):
    p = D.pairs(spark, d)
    a, b = p.filter("sim > 0.2").groupBy("code").agg(F.count("*").alias("ids")), p.filter("sim > 0.35").groupBy("code").agg(F.count("*").alias("comments"))
    return a.join(b, "code", "left").select("code", "ids", F.coalesce("comments", F.lit(0)).alias("comments"))


_RED = "red AS (SELECT code, elem, req, max(sim) AS sim FROM pairs WHERE sim > 0.05 GROUP BY ALL)"
_NEAR = _RED + ", cgb AS (SELECT caller AS elem, callee AS other FROM cg UNION ALL SELECT callee, caller FROM cg), nr AS (SELECT code, elem, req, sim, FALSE AS near FROM red UNION ALL SELECT o.code, o.elem, r.req, r.sim, TRUE FROM (SELECT DISTINCT code, elem FROM red) o JOIN cgb USING (elem) JOIN red r ON r.elem = cgb.other)"


def _reduced(spark, d):
    return L.reduce_requirements(L.threshold(D.pairs(spark, d), F.lit(0.05)), "max")


def _rows(spark, d, direction="both"):
    return L.neighbour_rows(materialize(_reduced(spark, d), "reduced"), D.call_edges(spark, d), direction)


@query("jn06_neighbours", f"{_PAIRS}, {_NEAR} SELECT elem, req, near, count(*) AS n, round(sum(sim), 6) AS total FROM nr GROUP BY ALL")
def jn06(spark, d):
    return _rows(spark, d).groupBy("elem", "req", "near").agg(F.count("*").alias("n"), F.round(F.sum("sim"), 6).alias("total"))


@query("jn07_semi", f"WITH {D.TRACE_SQL} SELECT tool, req, code, round(sim, 6) AS sim FROM hits WHERE hit = 1")
def jn07(spark, d):
    return M.with_hits(D.trace_scores(spark, d), D.trace_gold(spark, d)).filter("hit = 1").select("tool", "req", "code", F.round("sim", 6).alias("sim"))


@query("jn08_completion", f"WITH {D.TRACE_SQL}, r AS (SELECT DISTINCT tool, req FROM scores), c AS (SELECT DISTINCT tool, code FROM scores) SELECT tool, req, code, round(coalesce(sim, 0), 6) AS sim FROM (SELECT tool, req, code FROM r JOIN c USING (tool)) LEFT JOIN scores USING (tool, req, code)")
def jn08(spark, d):
    """The scores of each tool, with 0 for the missing pairs of all of its requirements and code files."""
    s = materialize(D.trace_scores(spark, d), "scores")
    return M.complete(s, s, s, run=("tool",)).select("tool", "req", "code", F.round("sim", 6).alias("sim"))


@query("jn09_inheritance_rule", f"{_PAIRS}, l AS (SELECT code, req, max(sim) AS sim FROM pairs GROUP BY ALL HAVING max(sim) > 0.3) SELECT code, req, round(sim, 6) AS sim FROM l UNION ALL SELECT super, req, NULL FROM l JOIN inh ON sub = code")
def jn09(spark, d):
    links = D.pairs(spark, d).groupBy("code", "req").agg(F.max("sim").alias("sim")).filter("sim > 0.3")
    return L.rule_links(links, D.inherits(spark, d), "up").withColumn("sim", F.round("sim", 6))


@query("jn10_call_rule", f"{_PAIRS}, l AS (SELECT code, req, max(sim) AS sim FROM pairs GROUP BY ALL HAVING max(sim) > 0.3), cc AS (SELECT DISTINCT caller // 20 AS a, callee // 20 AS b FROM cg WHERE caller // 20 <> callee // 20) SELECT code, req, round(sim, 6) AS sim FROM l UNION ALL SELECT b, req, NULL FROM l JOIN cc ON a = code UNION ALL SELECT a, req, NULL FROM l JOIN cc ON b = code")
def jn10(spark, d):
    links = D.pairs(spark, d).groupBy("code", "req").agg(F.max("sim").alias("sim")).filter("sim > 0.3")
    cls = D.call_edges(spark, d).select(F.floor(F.col("caller") / 20).cast("long").alias("sub"), F.floor(F.col("callee") / 20).cast("long").alias("super")).filter("sub <> super").distinct()
    return L.rule_links(links, cls, "both").withColumn("sim", F.round("sim", 6))


@query("jn11_class_files", "WITH f AS (SELECT file_id, any_value(class_name) AS class_name, any_value(file_name) AS file FROM code_file GROUP BY file_id) SELECT class_name, arg_max(file, file_id) AS file FROM f WHERE class_name IS NOT NULL GROUP BY class_name")
def jn11(spark, d):
    f = load(spark, d, "code_file").filter("class_name is not null").select("class_name", F.col("file_name").alias("file"), F.col("file_id").alias("ord"))
    return graph.class_files(f)


@query("jn12_file_word_weight", f"WITH {D.WORDS_SQL}, {_TFIDF.format('dw')} SELECT file, round(sum(weight), 6) AS total FROM dw JOIN wt USING (file, word) GROUP BY file")
def jn12(spark, d):
    t = D.doc_words(spark, d)
    return t.join(features.tfidf(t), ["file", "word"]).groupBy("file").agg(F.round(F.sum("weight"), 6).alias("total"))


_ISSUE = "iss AS (SELECT req_id, any_value(req_filename) AS req, any_value(req_text) AS txt, any_value(code) AS code FROM issue_entry GROUP BY req_id)"


@query("jn14_labelled_pairs", "WITH g AS (SELECT DISTINCT dataset, lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE dataset IS NOT NULL AND req_filename IS NOT NULL AND code_filename IS NOT NULL), r AS (SELECT DISTINCT dataset, req FROM g), c AS (SELECT DISTINCT dataset, code FROM g) SELECT 'r ' || r.req AS requirement, 'c ' || c.code AS code_entry, CASE WHEN g.req IS NULL THEN 0 ELSE 1 END AS valid, r.req AS requirement_filename, c.code AS code_filename, r.dataset FROM r JOIN c USING (dataset) LEFT JOIN g ON g.dataset = r.dataset AND g.req = r.req AND g.code = c.code")
def jn14(spark, d):
    """Every requirement against every code file of the gold links of its dataset."""
    t = load(spark, d, "trace_link").filter("dataset is not null and req_filename is not null and code_filename is not null")
    g = materialize(t.select("dataset", F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code")).distinct(), "gold")
    r = g.select("dataset", "req").distinct().withColumn("requirement", F.concat(F.lit("r "), "req"))
    c = g.select("dataset", "code").distinct().withColumn("code_entry", F.concat(F.lit("c "), "code"))
    return sampling.labelled_pairs(r, c, g)


@query("jn15_difference", f"WITH {D.TRACE_SQL} SELECT tool, req, code FROM hits WHERE hit = 0")
def jn15(spark, d):
    return D.trace_scores(spark, d).select("tool", "req", "code").join(D.trace_gold(spark, d), ["req", "code"], "left_anti").select("tool", "req", "code")


_POINTS = "pt AS (SELECT l_orderkey AS ind, sum(l_quantity) AS a, round(sum(l_discount), 4) AS b FROM lineitem GROUP BY 1)"


def _points(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ind")).agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_discount"), 4).alias("b"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("flt01_direction", f"{_PAIRS} SELECT req, count(*) FILTER (WHERE sim > 0.123456) AS above, count(*) FILTER (WHERE sim < 0.123456) AS below FROM pairs GROUP BY req")
def flt01(spark, d):
    p, t = D.pairs(spark, d), F.lit(0.123456)
    return p.groupBy("req").agg(F.count(F.when(V.better(F.col("sim"), t), 1)).alias("above"), F.count(F.when(V.better(F.col("sim"), t, True), 1)).alias("below"))


@query("flt04_file_threshold", f"WITH {D.TRACE_SQL} SELECT tool, count(*) FILTER (WHERE sim > 0.5) AS larger, count(*) FILTER (WHERE sim <= 0.5) AS reverse FROM scores GROUP BY tool")
def flt04(spark, d):
    s, t = D.trace_scores(spark, d), F.lit(0.5)
    x = L.file_threshold(s, t).select("tool", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(L.file_threshold(s, t, True).select("tool", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return x.groupBy("tool").agg(F.sum("a").alias("larger"), F.sum("b").alias("reverse"))


@query("flt05_finite", "SELECT tool, count(*) AS n FROM trace_score WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY tool")
def flt05(spark, d):
    return L.finite(load(spark, d, "trace_score"), "score").groupBy("tool").agg(F.count("*").alias("n"))


_GRID = "ge AS (SELECT unnest([0.05, 0.1, 0.2, 0.25])::DOUBLE AS e), gm AS (SELECT unnest([0.1, 0.15, 0.2, 0.25])::DOUBLE AS m), gf AS (SELECT unnest([0.1, 0.2, 0.25, 0.3, 0.35])::DOUBLE AS f), grid AS (SELECT e, m, f FROM ge, gm, gf WHERE e <= m AND m <= f)"


def _grid(spark):
    lists = ([0.05, 0.1, 0.2, 0.25], [0.1, 0.15, 0.2, 0.25], [0.1, 0.2, 0.25, 0.3, 0.35])
    return spark.createDataFrame([(e, m, f) for e in lists[0] for m in lists[1] for f in lists[2]], "e double, m double, f double")


@query("flt06_valid_cells", f"WITH {_GRID} SELECT e, m, f FROM grid")
def flt06(spark, d):
    return techniques.valid_cells(_grid(spark))


@query("flt11_voters", f"{_PAIRS} SELECT file AS code, count(*) FILTER (WHERE NOT is_req) AS methods FROM elem GROUP BY file HAVING count(*) FILTER (WHERE NOT is_req) > 0")
def flt11(spark, d):
    return features.voters(D.code_elements(spark, d), D.code_elements(spark, d), "optional").groupBy("code").agg(F.count("*").alias("methods"))


# --- link creation ---------------------------------------------------------------------------------------------


def _majority_sql(source: str, how: str = "max") -> str:
    return f"SELECT code, req, votes, round(sim, 6) AS sim FROM (SELECT *, max(votes) OVER (PARTITION BY code) AS mx FROM (SELECT code, req, count(*) AS votes, {how}(sim) AS sim FROM {source} GROUP BY code, req)) WHERE votes = mx"


def _links(df: DataFrame) -> DataFrame:
    return df.select("code", "req", F.col("votes").cast("long").alias("votes"), F.round("sim", 6).alias("sim"))


@query("agg01_req_reduce", f"{_PAIRS}, {_RED} SELECT code, elem, req, round(sim, 6) AS sim FROM red")
def agg01(spark, d):
    return _reduced(spark, d).withColumn("sim", F.round("sim", 6))


@query("agg02_majority", f"{_PAIRS}, {_RED}, v AS (SELECT * FROM red WHERE sim > 0.15) {_majority_sql('v')}")
def agg02(spark, d):
    return _links(L.majority_links(D.pairs(spark, d), F.lit(0.05), F.lit(0.15)))


@query("agg02_majority_reverse", f"{_PAIRS}, red AS (SELECT code, elem, req, min(1 - sim) AS sim FROM pairs WHERE 1 - sim < 0.95 GROUP BY ALL), v AS (SELECT * FROM red WHERE sim < 0.85) {_majority_sql('v', 'min')}")
def agg02r(spark, d):
    p = D.pairs(spark, d).withColumn("sim", 1 - F.col("sim"))
    return _links(L.majority_links(p, F.lit(0.95), F.lit(0.85), "min", "min", reverse=True))


@query("agg03_statistics", f"{_PAIRS}, {_RED}, v AS (SELECT * FROM red WHERE sim > 0.15), l AS ({_majority_sql('v')}), w AS (SELECT code, count(*) AS w FROM l GROUP BY 1), c AS (SELECT code, count(DISTINCT req) AS c FROM v GROUP BY 1) SELECT round(avg(w), 6) AS mean_winners, median(w)::DOUBLE AS median_winners, round(avg(c), 6) AS mean_candidates, median(c)::DOUBLE AS median_candidates FROM w JOIN c USING (code)")
def agg03(spark, d):
    votes = materialize(L.threshold(_reduced(spark, d), F.lit(0.15)), "votes")
    s = L.majority_statistics(L.majority(votes), votes)
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query("agg04_topn", f"{_PAIRS}, {_RED}, v AS (SELECT code, elem, req, sim FROM (SELECT *, row_number() OVER (PARTITION BY code, elem ORDER BY sim DESC, req) AS r FROM red) WHERE r <= 2) {_majority_sql('v')}")
def agg04(spark, d):
    return _links(L.top_n_links(D.pairs(spark, d), F.lit(0.05), 2))


@query("agg05_file_level", f"{_PAIRS} SELECT code, req, round(avg(sim), 6) AS sim FROM pairs GROUP BY code, req")
def agg05(spark, d):
    return D.pairs(spark, d).groupBy("code", "req").agg(F.round(F.avg("sim"), 6).alias("sim"))


@query("agg06_direction_counts", f"{_PAIRS}, {_RED} SELECT 'down' AS direction, count(*) AS n FROM (SELECT DISTINCT code, elem FROM red) o JOIN cg ON cg.caller = o.elem JOIN red r ON r.elem = cg.callee UNION ALL SELECT 'up', count(*) FROM (SELECT DISTINCT code, elem FROM red) o JOIN cg ON cg.callee = o.elem JOIN red r ON r.elem = cg.caller")
def agg06(spark, d):
    out = [_rows(spark, d, x).filter("near").agg(F.count("*").alias("n")).select(F.lit(x).alias("direction"), "n") for x in ("down", "up")]
    return out[0].unionByName(out[1])


@query("agg07_replicated", f"{_PAIRS}, {_NEAR}, c AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER w AS nc, sum(CASE WHEN near THEN 1 ELSE 0 END) OVER w AS nn FROM nr WINDOW w AS (PARTITION BY code, elem)), v AS (SELECT code, req, sim, CASE WHEN near OR nn = 0 THEN 1 ELSE 1 + greatest(0, round_even(3.0 * nn, 0) - nc) END AS n FROM c) SELECT code, req, votes, round(sim, 6) AS sim FROM (SELECT *, max(votes) OVER (PARTITION BY code) AS mx FROM (SELECT code, req, sum(n)::BIGINT AS votes, max(sim) AS sim FROM v GROUP BY ALL)) WHERE votes = mx")
def agg07(spark, d):
    return _links(L.replicated_votes(_rows(spark, d), 0.75))


@query("agg08_double_majority", f"{_PAIRS}, {_NEAR}, v AS (SELECT code, elem, near, req, max(sim) AS sim FROM nr GROUP BY ALL), i AS (SELECT code, elem, req, count(*) AS votes, max(sim) AS sim FROM v GROUP BY ALL), w AS (SELECT * FROM (SELECT *, max(votes) OVER (PARTITION BY code, elem) AS mx FROM i) WHERE votes = mx), b AS (SELECT * FROM (SELECT *, max(sim) OVER (PARTITION BY code, elem) AS ms FROM w) WHERE sim = ms) {_majority_sql('b')}")
def agg08(spark, d):
    return _links(L.double_majority(_rows(spark, d)))


@query("agg09_all_call", f"{_PAIRS}, {_NEAR} {_majority_sql('nr')}")
def agg09(spark, d):
    return _links(L.all_call_majority(_rows(spark, d)))


_SUMS = "ws AS (SELECT code, elem, req, CASE WHEN o IS NULL THEN n WHEN n IS NULL THEN o ELSE 0.8 * o + 0.2 * n END AS sim FROM (SELECT code, elem, req, max(sim) FILTER (WHERE NOT near) AS o, avg(sim) FILTER (WHERE near) AS n FROM nr GROUP BY ALL))"


@query("agg10_weighted_sum", f"{_PAIRS}, {_NEAR}, {_SUMS} SELECT elem, req, round(sim, 6) AS sim FROM ws")
def agg10(spark, d):
    return L.weighted_sums(_rows(spark, d), 0.8).select("elem", "req", F.round("sim", 6).alias("sim"))


@query("agg11_element_level", f"{_PAIRS}, {_NEAR}, {_SUMS}, v AS (SELECT * FROM ws WHERE sim > 0.15) {_majority_sql('v')}")
def agg11(spark, d):
    return _links(L.weighted_sum_links(D.pairs(spark, d), D.call_edges(spark, d), 0.8, F.lit(0.05), F.lit(0.15)))


@query("agg12_weighted_vectors", f"{_PAIRS}, cgb AS (SELECT caller AS elem, callee AS other FROM cg UNION ALL SELECT callee, caller FROM cg), x AS (SELECT elem, unnest(vec) AS x, unnest(range(64)) AS i FROM code_el), n AS (SELECT c.elem, x.i, avg(x.x) AS x FROM cgb c JOIN x ON x.elem = c.other JOIN code_el k ON k.elem = c.elem GROUP BY ALL), b AS (SELECT x.elem, x.i, CASE WHEN n.x IS NULL THEN x.x ELSE 0.8 * x.x + 0.2 * n.x END AS x FROM x LEFT JOIN n USING (elem, i)), v AS (SELECT elem, list(x ORDER BY i) AS vec FROM b GROUP BY elem), red AS (SELECT k.code, v.elem, r.req, max(list_dot_product(v.vec, r.vec) / sqrt(list_dot_product(v.vec, v.vec) * list_dot_product(r.vec, r.vec))) AS sim FROM v JOIN code_el k USING (elem), req_el r GROUP BY ALL), w AS (SELECT * FROM red WHERE sim > 0.15) {_majority_sql('w')}")
def agg12(spark, d):
    c = D.code_elements(spark, d)
    e = D.call_edges(spark, d)
    both = e.select(F.col("caller").alias("elem"), F.col("callee").alias("other")).unionByName(e.select(F.col("callee").alias("elem"), F.col("caller").alias("other")))
    near = V.mean_vector(both.join(c.select(F.col("elem").alias("other"), "vec"), "other"), ["elem"], "vec").select("elem", F.col("vec").alias("n"))
    mixed = c.join(near, "elem", "left").withColumn("vec", F.when(F.col("n").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "n", lambda x, y: 0.8 * x + 0.2 * y))).select("code", "elem", "vec")
    return _links(L.majority(L.threshold(L.reduce_requirements(similarity.cosine_pairs(mixed, D.req_parts(spark, d))), F.lit(0.15))))


_TWO = f"{_PAIRS}, a AS (SELECT code, elem, req, max(sim) AS sim FROM pairs WHERE part % 2 = 0 GROUP BY ALL HAVING max(sim) > 0.1), b AS (SELECT code, elem, req, max(sim) AS sim FROM pairs WHERE part % 2 = 1 GROUP BY ALL HAVING max(sim) > 0.12)"


def _two(spark, d):
    p = D.pairs(spark, d)
    return [L.threshold(L.reduce_requirements(p.filter(F.col("part") % 2 == k)), F.lit(t)) for k, t in ((0, 0.1), (1, 0.12))]


@query("agg13_separate", f"{_TWO}, la AS ({_majority_sql('a')}), lb AS ({_majority_sql('b')}) SELECT code, req, max(sim) AS sim FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY ALL")
def agg13(spark, d):
    a, b = _two(spark, d)
    return L.separate_majorities(L.majority(a), L.majority(b)).withColumn("sim", F.round("sim", 6))


@query("agg14_union", f"{_TWO}, u AS (SELECT code, req, sim FROM a UNION ALL SELECT code, req, sim FROM b) {_majority_sql('u')}")
def agg14(spark, d):
    return _links(L.union_majority(*_two(spark, d)))


@query("agg15_return_all", f"{_TWO} SELECT code, req, round(max(sim), 6) AS sim FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def agg15(spark, d):
    return L.return_all(*_two(spark, d)).withColumn("sim", F.round("sim", 6))


# --- evaluation ------------------------------------------------------------------------------------------------

_PRF = "found, hits, gold, round(CASE WHEN found = 0 THEN 0 ELSE hits / found END, 6) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE hits / gold END, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * hits / (found + gold) END, 6) AS f1"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("agg16_prf1", f"WITH {D.TRACE_SQL} SELECT tool, {_PRF} FROM (SELECT tool, count(*) AS found, sum(hit)::BIGINT AS hits, (SELECT count(*) FROM gold) AS gold FROM hits WHERE sim > 0.5 GROUP BY tool)")
def agg16(spark, d):
    return _rounded(M.evaluate(L.file_threshold(D.trace_scores(spark, d), F.lit(0.5)), D.trace_gold(spark, d), ("tool",)), "precision", "recall", "f1")


@query("agg17_duplicates", f"WITH {D.TRACE_SQL} SELECT tool, {_PRF} FROM (SELECT tool, 2 * count(*) AS found, sum(hit)::BIGINT AS hits, (SELECT count(*) FROM gold) AS gold FROM hits GROUP BY tool)")
def agg17(spark, d):
    s = D.trace_scores(spark, d)
    return _rounded(M.evaluate(s.unionByName(s.withColumn("req", F.upper("req"))), D.trace_gold(spark, d), ("tool",)), "precision", "recall", "f1")


_RANK = "rk AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER (PARTITION BY tool, req ORDER BY sim DESC, code, req ROWS UNBOUNDED PRECEDING) AS s FROM hits WINDOW w AS (PARTITION BY tool, req ORDER BY sim DESC, code, req))"


def _hits(spark, d):
    return M.with_hits(D.trace_scores(spark, d), D.trace_gold(spark, d))


@query("agg19_ap", f"WITH {D.TRACE_SQL}, {_RANK} SELECT tool, req, round(CASE WHEN sum(hit) = 0 THEN 0 ELSE sum(s / rank * hit) / sum(hit) END, 6) AS ap, sum(hit)::BIGINT AS hits FROM rk GROUP BY tool, req")
def agg19(spark, d):
    return _rounded(M.average_precision(_hits(spark, d), ("tool", "req")), "ap")


@query("agg20_map_at_k", f"WITH {D.TRACE_SQL}, {_RANK} SELECT tool, round(sum(ap) / (SELECT count(DISTINCT req) FROM gold), 6) AS map, 3::BIGINT AS k FROM (SELECT tool, req, CASE WHEN sum(hit) = 0 THEN 0 ELSE sum(s / rank * hit) / sum(hit) END AS ap FROM rk WHERE rank <= 3 GROUP BY tool, req) GROUP BY tool")
def agg20(spark, d):
    n = D.trace_gold(spark, d).select("req").distinct().count()
    return _rounded(M.map_at_k(_hits(spark, d), n, 3, run=("tool",)), "map")


@query("agg21_map_recall", f"WITH {D.TRACE_SQL}, {_RANK}, ks AS (SELECT unnest(range(1, (SELECT count(DISTINCT code) FROM (SELECT code FROM scores UNION SELECT code FROM gold)) + 1)) AS k), ap AS (SELECT tool, k, req, CASE WHEN sum(hit) = 0 THEN 0 ELSE sum(s / rank * hit) / sum(hit) END AS ap, sum(hit) AS h FROM ks JOIN rk ON rank <= k GROUP BY ALL) SELECT tool, k, round(sum(ap) / (SELECT count(DISTINCT req) FROM gold), 6) AS map, round(sum(h) / (SELECT count(*) FROM gold), 6) AS recall FROM ap GROUP BY tool, k")
def agg21(spark, d):
    """MAP and recall of each tool for every k up to the number of code files."""
    hits, gold = materialize(_hits(spark, d), "hits"), D.trace_gold(spark, d)
    g = gold.agg(F.countDistinct("req"), F.count("*")).first()
    n_codes = hits.select("code").union(gold.select("code")).distinct().count()
    return _rounded(M.map_and_recall(hits, g[0], g[1], n_codes, run=("tool",)), "map", "recall")


_SWEEP_F = "fs AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS f), cells AS (SELECT tool, f, count(*) AS found, sum(hit)::BIGINT AS hits, (SELECT count(*) FROM gold) AS gold FROM fs JOIN hits ON sim > f GROUP BY tool, f)"


def _cells(spark, d):
    fs = F.broadcast(spark.createDataFrame([(x / 10,) for x in range(1, 9)], "f double"))
    s = D.trace_scores(spark, d)
    return M.evaluate(s.join(fs, s["sim"] > fs["f"]), D.trace_gold(spark, d), ("tool", "f"))


@query("agg22_integral_ap", f"WITH {D.TRACE_SQL}, {_SWEEP_F}, c AS (SELECT tool, hits / gold AS recall, max(hits / found) AS precision FROM cells GROUP BY 1, 2) SELECT tool, round(sum((recall - p) * precision), 6) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY tool ORDER BY recall), 0) AS p FROM c) GROUP BY tool")
def agg22(spark, d):
    return _rounded(M.integral_average_precision(M.curve(_cells(spark, d), ("tool",)), ("tool",)), "ap")


@query("agg23_curves", f"WITH {D.TRACE_SQL}, {_SWEEP_F} SELECT tool, 'max' AS rule, round(hits / gold, 6) AS recall, round(max(hits / found), 6) AS precision FROM cells GROUP BY tool, hits / gold UNION ALL SELECT tool, 'last', round(hits / gold, 6), round(arg_max(hits / found, f), 6) FROM cells GROUP BY tool, hits / gold")
def agg23(spark, d):
    c = materialize(_cells(spark, d), "cells")
    both = M.curve(c, ("tool",)).withColumn("rule", F.lit("max")).unionByName(M.curve(c, ("tool",), "last", F.col("f")).withColumn("rule", F.lit("last")))
    return _rounded(both, "recall", "precision").select("tool", "rule", "recall", "precision")


@query("agg24_best_f1", f"WITH {D.TRACE_SQL}, {_SWEEP_F} SELECT tool, f, {_PRF} FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY 2 * hits / (found + gold) DESC, f) AS r FROM cells) WHERE r = 1")
def agg24(spark, d):
    return _rounded(M.best_cell(_cells(spark, d), ["f"], ("tool",)), "precision", "recall", "f1")


@query("agg25_grouped", "SELECT dataset, count(*) AS n, array_to_string(list_sort(list(DISTINCT lower(code_filename))), ' ') AS codes FROM trace_link WHERE code_filename IS NOT NULL GROUP BY dataset")
def agg25(spark, d):
    t = load(spark, d, "trace_link").filter("code_filename is not null")
    return t.groupBy("dataset").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.lower("code_filename"))), " ").alias("codes"))


@query("agg26_gold_statistics", f"WITH {D.TRACE_SQL} SELECT count(*) AS links, count(DISTINCT req) AS reqs, count(DISTINCT code) AS codes FROM gold")
def agg26(spark, d):
    return M.gold_statistics(D.trace_gold(spark, d))


_BY_SET = "g AS (SELECT DISTINCT dataset, lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE req_filename IS NOT NULL AND code_filename IS NOT NULL), gn AS (SELECT dataset, count(*) AS gold FROM g GROUP BY 1), sc AS (SELECT dataset, tool AS technique, lower(req_filename) AS req, lower(code_filename) AS code, max(score) AS sim FROM trace_score WHERE score IS NOT NULL AND NOT isnan(score) AND req_filename IS NOT NULL AND code_filename IS NOT NULL GROUP BY ALL), fs AS (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS f), cells AS (SELECT s.dataset, technique, f, count(*) AS found, count(g.req) AS hits, any_value(gold) AS gold FROM sc s JOIN fs ON sim > f JOIN gn USING (dataset) LEFT JOIN g ON g.dataset = s.dataset AND g.req = s.req AND g.code = s.code GROUP BY ALL), f1 AS (SELECT *, 2 * hits / (found + gold) AS f1 FROM cells)"


def _by_set(spark, d):
    t = load(spark, d, "trace_link").filter("req_filename is not null and code_filename is not null").select("dataset", F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code")).distinct().withColumn("hit", F.lit(1))
    s = L.finite(load(spark, d, "trace_score"), "score").filter("req_filename is not null and code_filename is not null").groupBy("dataset", F.col("tool").alias("technique"), F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code")).agg(F.max("score").alias("sim"))
    fs = F.broadcast(spark.createDataFrame([(0.2,), (0.4,), (0.6,)], "f double"))
    c = s.join(fs, s["sim"] > fs["f"]).join(t, ["dataset", "req", "code"], "left").groupBy("dataset", "technique", "f").agg(F.count("*").alias("found"), F.count("hit").alias("hits"))
    gold = t.groupBy("dataset").agg(F.count("*").alias("gold"))
    return c.join(F.broadcast(gold), "dataset").withColumn("f1", 2 * F.col("hits") / (F.col("found") + F.col("gold")))


@query("agg27_cross_project", f"WITH {_BY_SET} SELECT technique, f, round(avg(f1), 6) AS mean_f1 FROM f1 GROUP BY technique, f HAVING count(DISTINCT dataset) = 6")
def agg27(spark, d):
    return _rounded(M.best_config(_by_set(spark, d), ["technique", "f"], 6), "mean_f1")


@query("agg28_best_technique", f"WITH {_BY_SET} SELECT technique, round(avg(f1), 6) AS mean_best_f1 FROM (SELECT technique, dataset, max(f1) AS f1 FROM f1 GROUP BY ALL) GROUP BY technique")
def agg28(spark, d):
    return _rounded(M.best_technique(_by_set(spark, d)), "mean_best_f1")


@query("agg29_label_balance", f"WITH {D.TRACE_SQL} SELECT tool, sum(hit)::BIGINT AS valid, sum(1 - hit)::BIGINT AS invalid FROM hits GROUP BY tool")
def agg29(spark, d):
    return _hits(spark, d).groupBy("tool").agg(F.sum("hit").alias("valid"), F.sum(1 - F.col("hit")).alias("invalid"))


@query("agg30_issue_report", "WITH i AS (SELECT req_id, any_value(dataset) AS dataset, any_value(req_text) AS t, any_value(code) AS c, any_value(children) AS ch FROM issue_entry GROUP BY req_id) SELECT dataset, count(*) AS issues, count(*) FILTER (WHERE len(c) > 0) AS with_code, coalesce(sum(len(c)), 0)::BIGINT AS code_links, count(*) FILTER (WHERE cardinality(ch) > 0) AS with_children FROM i GROUP BY dataset")
def agg30(spark, d):
    i = load(spark, d, "issue_entry").select("req_id", "dataset", F.size("code").alias("c"), F.size("children").alias("ch")).distinct()
    return i.groupBy("dataset").agg(F.count("*").alias("issues"), F.count(F.when(F.col("c") > 0, 1)).alias("with_code"), F.coalesce(F.sum(F.greatest("c", F.lit(0))), F.lit(0)).cast("long").alias("code_links"), F.count(F.when(F.col("ch") > 0, 1)).alias("with_children"))


@query("win01_precision_at", f"WITH {D.TRACE_SQL}, {_RANK} SELECT tool, req, code, rank, round(s / rank, 6) AS precision_at FROM rk")
def win01(spark, d):
    return M.ranked(_hits(spark, d), ("tool", "req")).select("tool", "req", "code", F.col("rank").cast("long").alias("rank"), F.round("precision_at", 6).alias("precision_at"))


@query("win05_crowding", f"WITH {_POINTS}, p AS (SELECT ind, ind % 5 AS front, a, b FROM pt), l AS (SELECT ind, front, 'a' AS dim, a AS v FROM p UNION ALL SELECT ind, front, 'b', b FROM p), g AS (SELECT ind, front, CASE WHEN mx = mn THEN 0 WHEN lo IS NULL OR hi IS NULL THEN 'inf'::DOUBLE ELSE (hi - lo) / (2 * (mx - mn)) END AS g FROM (SELECT *, lag(v) OVER w AS lo, lead(v) OVER w AS hi, max(v) OVER (PARTITION BY front, dim) AS mx, min(v) OVER (PARTITION BY front, dim) AS mn FROM l WINDOW w AS (PARTITION BY front, dim ORDER BY v, ind))) SELECT ind, front, CASE WHEN isinf(sum(g)) THEN -1 ELSE round(sum(g), 6) END AS crowding FROM g GROUP BY ind, front")
def win05(spark, d):
    c = evolve.crowding(_points(spark, d).withColumn("front", F.col("ind") % 5), ["a", "b"])
    return c.withColumn("crowding", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)))


@query("win08_call_tree", "WITH x AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey, l_suppkey FROM lineitem), t AS (SELECT file, n, CASE WHEN n = 1 THEN 0 ELSE least(n - 1, l_suppkey % 3) END AS depth, 'f' || (l_partkey % 50) AS name FROM x), p AS (SELECT c.file, c.n, c.name, max(q.n) AS pn FROM t c JOIN t q ON q.file = c.file AND q.n < c.n AND q.depth = c.depth - 1 GROUP BY ALL) SELECT p.file, t.name AS caller, p.name AS callee FROM p JOIN t ON t.file = p.file AND t.n = p.pn")
def win08(spark, d):
    """The lines of an order as an indented call tree of at most three levels."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(w).alias("line_no"), "l_partkey", "l_suppkey")
    depth = F.when(F.col("line_no") == 1, 0).otherwise(F.least(F.col("line_no") - 1, F.col("l_suppkey") % 3)).cast("int")
    return graph.call_tree_edges(x.select("file", "line_no", F.concat(F.repeat(F.lit("    "), depth), F.lit("f"), (F.col("l_partkey") % 50).cast("string"), F.lit("() <int f () at m.c:1>")).alias("line")))


# --- sorts and sets --------------------------------------------------------------------------------------------


@query("srt01_stable_order", f"WITH {D.TRACE_SQL} SELECT tool, req, code, row_number() OVER (PARTITION BY tool, req ORDER BY sim DESC, code) AS pos FROM scores")
def srt01(spark, d):
    w = Window.partitionBy("tool", "req").orderBy(F.col("sim").desc(), "code")
    return D.trace_scores(spark, d).select("tool", "req", "code", F.row_number().over(w).cast("long").alias("pos"))


@query("srt05_survivors", f"WITH {_POINTS} SELECT ind, ind % 5 AS front, a AS crowding FROM pt ORDER BY front, a DESC, ind LIMIT 50")
def srt05(spark, d):
    return evolve.survivors(_points(spark, d).select("ind", (F.col("ind") % 5).alias("front"), F.col("a").alias("crowding")), 50)


@query("srt07_transpose", "SELECT o_orderpriority AS req, o_orderstatus AS code, round(sum(o_totalprice), 2) AS sim FROM orders GROUP BY 1, 2")
def srt07(spark, d):
    long = load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("req")).agg(F.round(F.sum("o_totalprice"), 2).alias("sim"))
    wide = S.to_matrix(long, "code", "req")
    names = [c for c in wide.columns if c != "code"]
    return wide.unpivot(["code"], names, "req", "sim").filter("sim is not null").select("req", "code", "sim")


_TL = "SELECT dataset, req_filename, code_filename FROM trace_link"


@query("set01_union", f"SELECT * FROM ({_TL} WHERE dataset < 'd') UNION SELECT * FROM ({_TL} WHERE dataset > 'b')")
def set01(spark, d):
    t = load(spark, d, "trace_link")
    return t.filter("dataset < 'd'").unionByName(t.filter("dataset > 'b'")).distinct()


@query("set02_remove", f"SELECT DISTINCT lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE code_filename IS NOT NULL AND lower(code_filename) NOT LIKE 'db%' AND req_filename IS NOT NULL")
def set02(spark, d):
    g = D.trace_gold(spark, d)
    return g.join(g.filter("code like 'db%'"), ["req", "code"], "left_anti")


@query("set03_multiset_equal", f"SELECT count(*) AS surplus FROM ({_TL} EXCEPT ALL SELECT DISTINCT * FROM ({_TL}))")
def set03(spark, d):
    t = load(spark, d, "trace_link")
    return t.exceptAll(t.distinct()).agg(F.count("*").alias("surplus"))


@query("set04_difference", f"SELECT * FROM ({_TL}) EXCEPT SELECT * FROM ({_TL} WHERE dataset = 'altavia')")
def set04(spark, d):
    t = load(spark, d, "trace_link")
    return t.subtract(t.filter("dataset = 'altavia'"))


@query("set05_first_links", "SELECT req, code, sim FROM (SELECT lower(req_filename) AS req, lower(code_filename) AS code, score AS sim, row_number() OVER (PARTITION BY lower(req_filename), lower(code_filename) ORDER BY tool, score) AS r FROM trace_score WHERE NOT isnan(score)) WHERE r = 1")
def set05(spark, d):
    s = load(spark, d, "trace_score").filter("score is not null and not isnan(score)").select(F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code"), "tool", "score")
    return s.groupBy("req", "code").agg(F.min(F.struct("tool", "score")).alias("m")).select("req", "code", F.col("m.score").alias("sim"))


@query("set07_rules", f"{_PAIRS}, l AS (SELECT code, req, max(sim) AS sim FROM pairs GROUP BY ALL HAVING max(sim) > 0.3), u AS (SELECT code, req, sim FROM l UNION ALL SELECT super, req, NULL FROM l JOIN inh ON sub = code) SELECT count(*) AS n, count(sim) AS with_sim, count(DISTINCT (code, req)) AS pairs FROM u")
def set07(spark, d):
    links = D.pairs(spark, d).groupBy("code", "req").agg(F.max("sim").alias("sim")).filter("sim > 0.3")
    u = L.rule_links(links, D.inherits(spark, d))
    return u.groupBy("code", "req").agg(F.count("*").alias("n"), F.count("sim").alias("s")).agg(F.sum("n").alias("n"), F.sum("s").alias("with_sim"), F.count("*").alias("pairs"))


@query("set08_word_sets", f"WITH {D.IDENT_SQL} SELECT method_id, len(list_distinct(t || ['int', 'String'])) AS both, len(list_intersect(t, ['int', 'String'])) AS shared FROM ident")
def set08(spark, d):
    other = F.array(F.lit("int"), F.lit("String"))
    return D.identifiers(spark, d).select("method_id", F.size(F.array_union("t", other)).cast("long").alias("both"), F.size(F.array_intersect("t", other)).cast("long").alias("shared"))


@query("set09_known_edges", f"{_PAIRS} SELECT DISTINCT caller, callee FROM cg JOIN elem x ON x.id = caller JOIN elem y ON y.id = callee")
def set09(spark, d):
    return graph.to_known(D.call_edges(spark, d), D.elem(spark, d).select(F.col("id").alias("node")))


# --- sampling and labelled data --------------------------------------------------------------------------------


@query("smp01_sample", f"WITH {D.TRACE_SQL} SELECT req, code FROM (SELECT *, row_number() OVER (ORDER BY md5(req || '|' || code || '|7'), req || '|' || code) AS r FROM gold) WHERE r <= ceil((SELECT count(*) FROM gold) * 0.3)")
def smp01(spark, d):
    return sampling.sample_share(D.trace_gold(spark, d).withColumn("key", F.concat_ws("|", "req", "code")), "key", 0.3, 7).filter("chosen").select("req", "code")


def _free_sql(side: str, column: str) -> str:
    """Files of a side: linked ones are chosen with a chosen link, others by their own sample."""
    return f"""{side}_linked AS (SELECT {side} AS file, bool_or(chosen) AS chosen FROM lk GROUP BY 1), {side}_free AS (SELECT file, row_number() OVER (ORDER BY md5(file || '|11'), file) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT lower({column}) AS file FROM trace_score WHERE req_filename IS NOT NULL AND code_filename IS NOT NULL) WHERE file NOT IN (SELECT file FROM {side}_linked))"""


@query("smp02_split", f"WITH {D.TRACE_SQL}, lk AS (SELECT req, code, r <= ceil(n * 0.5) AS chosen FROM (SELECT *, row_number() OVER (ORDER BY md5(req || '|' || code || '|11'), req || '|' || code) AS r, count(*) OVER () AS n FROM gold)), {_free_sql('req', 'req_filename')}, {_free_sql('code', 'code_filename')} SELECT 'req' AS side, file, chosen FROM req_linked UNION ALL SELECT 'req', file, r <= ceil(n * 0.5) FROM req_free UNION ALL SELECT 'code', file, chosen FROM code_linked UNION ALL SELECT 'code', file, r <= ceil(n * 0.5) FROM code_free")
def smp02(spark, d):
    g = D.trace_gold(spark, d)
    s = load(spark, d, "trace_score").filter("req_filename is not null and code_filename is not null")
    r, c = sampling.split_gold(g, s.select(F.lower("req_filename").alias("req")), s.select(F.lower("code_filename").alias("code")), 0.5, 11)
    return r.select(F.lit("req").alias("side"), F.col("req").alias("file"), "chosen").unionByName(c.select(F.lit("code").alias("side"), F.col("code").alias("file"), "chosen"))


@query("smp04_entries", f"WITH {_ISSUE} SELECT req_id, i - 1 AS pos, regexp_replace(s[i], '[.!;?]$', '') AS requirement FROM (SELECT req_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT req_id, {_SENT.replace('text', 'txt')} AS s FROM iss WHERE txt IS NOT NULL))")
def smp04(spark, d):
    i = first_delivery(load(spark, d, "issue_entry").select("req_id", "req_text", "loaded_at"), "req_id").filter("req_text is not null")
    s = i.select("req_id", F.posexplode(T.no_last_mark(T.sentences(F.col("req_text")))).alias("pos", "requirement"))
    return s.withColumn("pos", F.col("pos").cast("long"))


# --- evolutionary search ---------------------------------------------------------------------------------------


@query("ga01_fitness", "SELECT o_custkey AS ind, round(avg(y.l_discount), 9) AS value FROM orders JOIN lineitem x ON x.l_orderkey = o_orderkey JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber GROUP BY 1")
def ga01(spark, d):
    ind = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("ind"), F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("code"))
    sims = load(spark, d, "lineitem").select(F.lit("x").alias("dim"), F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("code"), F.col("l_discount").alias("sim"))
    return evolve.fitness(ind, sims).select("ind", F.round("value", 9).alias("value"))


@query("ga07_twins", "SELECT count(*) AS kept FROM (SELECT DISTINCT list_sort(list(DISTINCT (l_partkey % 3, l_linenumber))) FROM lineitem GROUP BY l_orderkey)")
def ga07(spark, d):
    ind = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("ind"), (F.col("l_partkey") % 3).alias("req"), F.col("l_linenumber").alias("code"))
    return evolve.without_twins(ind).select("ind").distinct().agg(F.count("*").alias("kept"))


@query("ns03_dimensions", "SELECT l_orderkey AS ind, sum(l_quantity) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1")
def ns03(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ind")).agg(F.sum("l_quantity").alias("q"), F.round(F.avg("l_discount"), 6).alias("d"))


# --- sweeps ----------------------------------------------------------------------------------------------------

_SWEEP = f"""{_PAIRS}, {_GRID}, em AS (SELECT DISTINCT e, m FROM grid),
red AS (SELECT e, m, code, elem, req, max(sim) AS sim FROM pairs JOIN em ON sim > e GROUP BY ALL HAVING max(sim) > m),
votes AS (SELECT e, m, code, req, count(*) AS n, max(sim) AS sim FROM red GROUP BY ALL),
lk AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY e, m, code) AS mx FROM votes) WHERE n = mx),
kept AS (SELECT e, m, f, l.code, l.req, l.sim FROM lk l JOIN grid USING (e, m) WHERE l.sim > f)"""


@query("swp01_sweep", f"{_SWEEP} SELECT e, m, f, {_PRF} FROM (SELECT e, m, f, count(*) AS found, count(g.req) AS hits, (SELECT count(*) FROM gold) AS gold FROM kept k LEFT JOIN gold g ON g.req = k.req AND g.code = k.code GROUP BY e, m, f)")
def swp01(spark, d):
    return _rounded(techniques.sweep(D.pairs(spark, d), _grid(spark), D.gold(spark, d)), "precision", "recall", "f1")


@query("swp01_sweep_reverse", f"""{_PAIRS}, ge AS (SELECT unnest([0.95, 0.9])::DOUBLE AS e), gm AS (SELECT unnest([0.9, 0.8])::DOUBLE AS m), gf AS (SELECT unnest([0.85, 0.75])::DOUBLE AS f), grid AS (SELECT * FROM ge, gm, gf WHERE e >= m AND m >= f), em AS (SELECT DISTINCT e, m FROM grid),
red AS (SELECT e, m, code, elem, req, min(1 - sim) AS sim FROM pairs JOIN em ON 1 - sim < e GROUP BY ALL HAVING min(1 - sim) < m),
votes AS (SELECT e, m, code, req, count(*) AS n, min(sim) AS sim FROM red GROUP BY ALL), lk AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY e, m, code) AS mx FROM votes) WHERE n = mx),
kept AS (SELECT e, m, f, l.code, l.req FROM lk l JOIN grid USING (e, m) WHERE l.sim <= f) SELECT e, m, f, {_PRF} FROM (SELECT e, m, f, count(*) AS found, count(g.req) AS hits, (SELECT count(*) FROM gold) AS gold FROM kept k LEFT JOIN gold g ON g.req = k.req AND g.code = k.code GROUP BY e, m, f)""")
def swp01r(spark, d):
    grid = spark.createDataFrame([(e, m, f) for e in (0.95, 0.9) for m in (0.9, 0.8) for f in (0.85, 0.75)], "e double, m double, f double")
    p = D.pairs(spark, d).withColumn("sim", 1 - F.col("sim"))
    return _rounded(techniques.sweep(p, grid, D.gold(spark, d), how_req="min", how_code="min", reverse=True), "precision", "recall", "f1")


@query("swp02_topn_sizes", "SELECT DISTINCT round_even(n * p, 0)::BIGINT AS n FROM (SELECT count(DISTINCT dataset) AS n FROM trace_link), (SELECT unnest([0.2, 0.3, 0.5, 0.55])::DOUBLE AS p)")
def swp02(spark, d):
    n = load(spark, d, "trace_link").agg(F.countDistinct("dataset").alias("n"))
    return n.select(F.explode(F.array(*(V.top_percent(F.col("n"), p) for p in (0.2, 0.3, 0.5, 0.55)))).alias("n")).distinct()


@query("swp04_refine")
def swp04(spark, d):
    best = techniques.refine_best(materialize(D.pairs(spark, d), "pairs"), _grid(spark), D.gold(spark, d))
    return spark.createDataFrame([tuple(float(best[k]) for k in ("e", "m", "f", "f1"))] if best else [], "e double, m double, f double, f1 double")


@query("swp07_third_party", f"WITH {D.TRACE_SQL}, {_SWEEP_F} SELECT tool, f, {_PRF} FROM cells")
def swp07(spark, d):
    return _rounded(_cells(spark, d), "precision", "recall", "f1")


@query("swp10_rules_in_sweep", f"{_SWEEP}, k2 AS (SELECT e, m, f, code, req FROM kept UNION ALL SELECT e, m, f, super, req FROM kept JOIN inh ON sub = code) SELECT e, m, f, {_PRF} FROM (SELECT e, m, f, sum(n)::BIGINT AS found, count(g.req) AS hits, (SELECT count(*) FROM gold) AS gold FROM (SELECT e, m, f, code, req, count(*) AS n FROM k2 GROUP BY ALL) k LEFT JOIN gold g ON g.req = k.req AND g.code = k.code GROUP BY e, m, f)")
def swp10(spark, d):
    return _rounded(techniques.sweep(D.pairs(spark, d), _grid(spark), D.gold(spark, d), rules=D.inherits(spark, d)), "precision", "recall", "f1")


# --- sources and sinks: written into the shared folder and read again --------------------------------------------


def _path(spark, name: str) -> str:
    return f"{own_dir(spark)}/io/{name}-{uuid.uuid4().hex}"


@query("src02_texts", "SELECT count(*) AS files, sum(length(regexp_replace(content, '^\ufeff', '')))::BIGINT AS chars FROM (SELECT file_id, any_value(content) AS content FROM code_file GROUP BY file_id) WHERE content IS NOT NULL AND content <> ''".replace("\\ufeff", chr(0xFEFF)).replace("\ufeff", chr(0xFEFF)))
def src02(spark, d):
    """Sources written as text files, one record a line with its line ends escaped, and read as whole texts."""
    f = first_delivery(load(spark, d, "code_file").select("file_id", "content", "loaded_at"), "file_id").filter("content is not null and content <> ''")
    p = _path(spark, "texts")
    f.select(F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"\s", "").alias("value")).repartition(4).write.text(p)
    lines = R.lines(R.texts(spark, p, "*.txt")).filter("line <> ''")
    body = F.regexp_replace(F.unbase64("line").cast("string"), "^" + chr(0xFEFF), "")
    return lines.agg(F.count("*").alias("files"), F.sum(F.length(body)).alias("chars"))


@query("src04_csv", "SELECT dataset, req_filename, code_filename FROM trace_link WHERE code_filename IS NOT NULL")
def src04(spark, d):
    t = load(spark, d, "trace_link").filter("code_filename is not null").select("dataset", "req_filename", "code_filename")
    p = _path(spark, "csv")
    S.write_csv(t, p)
    return R.csv(spark, p, "dataset string, req_filename string, code_filename string")


@query("src06_matrix", "SELECT o_orderpriority AS req, o_orderstatus AS code, round(sum(o_totalprice), 2) AS sim FROM orders GROUP BY 1, 2")
def src06(spark, d):
    long = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("req"), F.col("o_orderstatus").alias("code")).agg(F.round(F.sum("o_totalprice"), 2).alias("sim"))
    p = _path(spark, "matrix")
    S.write_csv(S.to_matrix(long, columns=["F", "O", "P"]), p, single=True)
    return R.matrix(spark, p).filter("sim is not null")


@query("src07_json", "SELECT req_id, any_value(issueid) AS issueid, any_value(attributes).summary AS summary, len(any_value(code)) AS n_code FROM issue_entry GROUP BY req_id")
def src07(spark, d):
    i = first_delivery(load(spark, d, "issue_entry").select("req_id", "issueid", "attributes", "code", "loaded_at"), "req_id")
    p = _path(spark, "json")
    S.write_json(i.select("req_id", "issueid", "attributes", "code"), p)
    j = spark.read.schema("req_id long, issueid string, attributes struct<summary:string,description:string>, code array<struct<filename:string>>").json(p)
    return j.select("req_id", "issueid", F.col("attributes.summary").alias("summary"), F.when(F.col("code").isNotNull(), F.size("code")).cast("long").alias("n_code"))


@query("src08_gold_xml", "SELECT DISTINCT lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE req_filename IS NOT NULL AND code_filename IS NOT NULL")
def src08(spark, d):
    """The gold set as XML documents, one for each kind of requirement, read as whole documents."""
    p = _path(spark, "xml")
    link = F.concat(F.lit("<link><req>"), "req", F.lit("</req><note/><code>"), "code", F.lit("</code></link>"))
    docs = D.trace_gold(spark, d).groupBy(F.pmod(F.xxhash64("req"), F.lit(64)).alias("part")).agg(F.concat(F.lit("<links>"), F.concat_ws("", F.collect_list(link)), F.lit("</links>")).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(p)
    return R.gold_xml(spark, p)


@query("src09_gold_text", "SELECT DISTINCT lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE req_filename IS NOT NULL AND code_filename IS NOT NULL")
def src09(spark, d):
    p = _path(spark, "gold")
    S.write_lines(S.gold_lines(D.trace_gold(spark, d)), p)
    return R.gold_text(spark.read.text(p))


@query("src10_combined_csv", "SELECT dataset, count(*) AS n FROM trace_link WHERE code_filename IS NOT NULL GROUP BY dataset")
def src10(spark, d):
    t = load(spark, d, "trace_link").filter("code_filename is not null").select("dataset", "req_filename", "code_filename")
    a, b = _path(spark, "csv"), _path(spark, "csv")
    S.write_csv(t.filter("dataset < 'd'"), a)
    S.write_csv(t.filter("dataset >= 'd'"), b)
    return R.csv(spark, [a, b], "dataset string, req_filename string, code_filename string").groupBy("dataset").agg(F.count("*").alias("n"))


@query("src11_third_party", f"WITH {D.TRACE_SQL} SELECT tool, regexp_replace(req, '[.]txt$', '') AS req, code, round(sim, 6) AS sim FROM scores")
def src11(spark, d):
    """One directory of score files for each tool, written and read again."""
    p = _path(spark, "scores")
    D.trace_scores(spark, d).select("tool", F.concat_ws(" ", "req", F.concat(F.lit("org.pkg."), "code"), F.col("sim").cast("string")).alias("value")).write.partitionBy("tool").text(p)
    lines = spark.read.schema("value string, tool string").text(p).select(F.lit(6).alias("pos"), F.col("value").alias("line"), "tool")
    return R.third_party_scores(lines, keep=("tool",)).withColumn("sim", F.round("sim", 6))


@query("src12_call_graph", f"{_PAIRS} SELECT DISTINCT 'M' AS kind, 'org.app.C' || (caller // 20) AS caller_class, 'm' || caller || '(int)' AS caller, 'org.app.C' || (callee // 20) AS callee_class, 'm' || callee || '(int)' AS callee FROM cg WHERE caller % 4 <> 0")
def src12(spark, d):
    """The call graph as lines of text, a part of its calls coming from an external package, read and cleaned."""
    e = D.call_edges(spark, d)
    name = lambda c: F.concat(F.when(F.col("caller") % 4 == 0, "java.util.C").otherwise("org.app.C") if c == "caller" else F.lit("org.app.C"), F.floor(F.col(c) / 20).cast("string"))
    lines = e.select(F.concat(F.lit("M:"), name("caller"), F.lit(":m"), F.col("caller").cast("string"), F.lit("(int) (M)"), name("callee"), F.lit(":m"), F.col("callee").cast("string"), F.lit("(int)")).alias("line"))
    p = _path(spark, "calls")
    S.write_lines(lines.select(F.col("line").alias("value")), p)
    return graph.internal_edges(graph.call_graph_rows(spark.read.text(p).select(F.col("value").alias("line"))), ["org"])


@query("src14_descendants", "WITH RECURSIVE i AS (SELECT req_id, any_value(issueid) AS issueid, any_value(children) AS ch FROM issue_entry GROUP BY req_id), e AS (SELECT DISTINCT issueid, unnest(flatten(map_values(ch))) AS child FROM i WHERE issueid IS NOT NULL), r(root, issueid) AS (SELECT DISTINCT issueid, issueid FROM i WHERE issueid IS NOT NULL UNION SELECT r.root, e.child FROM r JOIN e ON e.issueid = r.issueid WHERE e.child IS NOT NULL) SELECT root, count(*) AS reached FROM r GROUP BY root")
def src14(spark, d):
    i = load(spark, d, "issue_entry").select("req_id", "issueid", "children", "loaded_at")
    return graph.descend(first_delivery(i, "req_id")).groupBy("root").agg(F.count("*").alias("reached"))


@query("src15_trace_pairs", f"{_PAIRS} SELECT elem::VARCHAR AS elem, part::VARCHAR AS part, round(sim, 6) AS sim FROM pairs")
def src15(spark, d):
    s = D.pairs(spark, d).select(*(F.col(c).cast("string").alias(c) for c in ("code", "elem", "req", "part")), "sim")
    p = _path(spark, "pairs")
    S.write_json(S.nest_trace_pairs(s).select(F.array(F.struct("code_filename", "code_element_list")).alias("code_file_list")), p)
    return R.trace_pairs(spark.read.schema(R.TRACE_PAIRS).json(p)).select("elem", "part", F.round("sim", 6).alias("sim"))


@query("src16_embeddings", f"{_PAIRS} SELECT code::VARCHAR AS file, count(*) AS n, round(sum(vec[1]), 6) AS x FROM code_el GROUP BY 1")
def src16(spark, d):
    e = D.code_elements(spark, d).groupBy(F.col("code").cast("string").alias("file_path")).agg(F.collect_list("vec").alias("sub_vectors")).withColumn("vector", F.element_at("sub_vectors", 1))
    p = _path(spark, "embeddings")
    S.write_json(e, p)
    return R.embeddings(spark.read.schema(R.EMBEDDING).json(p)).filter("pos >= 0").groupBy("file").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("vec", 1)), 6).alias("x"))


@query("src17_eval_matrix", f"WITH {D.TRACE_SQL}, {_SWEEP_F} SELECT tool, f, found, hits FROM cells")
def src17(spark, d):
    p = _path(spark, "eval")
    S.write_json(_cells(spark, d), p)
    return spark.read.schema("tool string, f double, found long, hits long").json(p)


@query("src18_saved_links", f"{_SWEEP} SELECT req, code FROM kept WHERE e = 0.1 AND m = 0.2 AND f = 0.25")
def src18(spark, d):
    p = _path(spark, "links")
    S.write_csv(S.links_of_cell(techniques.sweep_links(D.pairs(spark, d), techniques.valid_cells(_grid(spark))), 0.1, 0.2, 0.25), p)
    return R.csv(spark, p, "req long, code long")


@query("src19_inverted", "SELECT o_orderpriority AS req, o_orderstatus || '.java' AS code, round(1 - avg(o_totalprice) / 1000000, 6) AS sim FROM orders GROUP BY 1, 2")
def src19(spark, d):
    long = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("req"), F.concat("o_orderstatus", F.lit(".txt")).alias("code")).agg((F.avg("o_totalprice") / 1000000).alias("sim"))
    p = _path(spark, "matrix")
    S.write_csv(S.to_matrix(long, columns=["F.txt", "O.txt", "P.txt"]), p, single=True)
    return R.similarity_matrix(spark, p, invert=True, extension="java").filter("sim is not null").withColumn("sim", F.round("sim", 6))


@query("src20_word_vectors", f"{_PAIRS} SELECT elem::VARCHAR AS word, round(list_dot_product(vec, vec), 6) AS square FROM code_el")
def src20(spark, d):
    p = _path(spark, "vec")
    D.code_elements(spark, d).select(F.concat_ws(" ", F.col("elem").cast("string"), F.array_join(F.transform("vec", lambda x: (x * 3).cast("string")), " ")).alias("value")).write.text(p)
    return R.word_vector_text(spark, p).select("word", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("square"))


@query("src21_name_lists", "SELECT list_name, count(*) AS n FROM (SELECT DISTINCT list_name, trim(req_filename) AS f FROM split_list WHERE trim(req_filename) <> '') GROUP BY list_name")
def src21(spark, d):
    s = load(spark, d, "split_list")
    out = [R.file_names(s.filter(F.col("list_name") == x).select(F.col("req_filename").alias("value"))).agg(F.count("*").alias("n")).select(F.lit(x).alias("list_name"), "n") for x in ("chosen", "remaining")]
    return out[0].unionByName(out[1])


@query("src23_counts", "SELECT count(*) AS files, count(DISTINCT file_name) AS names FROM (SELECT file_id, any_value(file_name) AS file_name FROM code_file GROUP BY file_id)")
def src23(spark, d):
    f = load(spark, d, "code_file").select("file_id", "file_name").distinct()
    return f.groupBy("file_name").agg(F.count("*").alias("n")).agg(F.sum("n").alias("files"), F.count("file_name").alias("names"))


@query("snk01_curve", f"WITH {D.TRACE_SQL}, {_SWEEP_F} SELECT tool, round(hits / gold, 6) AS recall, round(max(hits / found), 6) AS precision FROM cells GROUP BY tool, hits / gold")
def snk01(spark, d):
    p = _path(spark, "curve")
    S.write_curve(M.curve(_cells(spark, d), ("tool",)), p, ("tool",))
    return _rounded(R.csv(spark, p, "tool string, recall double, precision double"), "recall", "precision")


@query("snk04_grid", f"{_SWEEP}, c AS (SELECT e, m, f, count(*) AS n FROM kept GROUP BY ALL) SELECT e, m, max(n) FILTER (WHERE f = 0.25) AS a, max(n) FILTER (WHERE f = 0.3) AS b FROM c GROUP BY e, m")
def snk04(spark, d):
    c = techniques.sweep_links(D.pairs(spark, d), techniques.valid_cells(_grid(spark))).groupBy("e", "m", "f").agg(F.count("*").alias("n"))
    g = S.threshold_grid(c, "n")
    return g.select("e", "m", F.col("`0.25`").alias("a"), F.col("`0.3`").alias("b"))


@query("snk06_gold_lines", f"WITH {D.TRACE_SQL} SELECT req || ':' || array_to_string(list_sort(list(DISTINCT code)), ' ') AS value FROM gold GROUP BY req")
def snk06(spark, d):
    return S.gold_lines(D.trace_gold(spark, d))


@query("snk08_partitioned", f"{_PAIRS} SELECT code, count(*) AS n FROM code_el GROUP BY code")
def snk08(spark, d):
    p = S.output_path(_path(spark, "table"), "embedding", technique="plain")
    S.write_table(D.code_elements(spark, d), p, "code")
    return spark.read.parquet(p).groupBy(F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))


@query("snk10_token_dump", f"WITH {D.IDENT_SQL} SELECT array_to_string(t, ' ') AS value FROM ident WHERE len(t) > 0 AND array_to_string(t, ' ') <> ''")
def snk10(spark, d):
    p = _path(spark, "dump")
    S.write_lines(S.text_lines(D.identifiers(spark, d), "t"), p)
    return spark.read.text(p).filter("value <> ''")


@query("snk12_valid_links", f"{_SWEEP} SELECT k.req, k.code FROM kept k JOIN gold g ON g.req = k.req AND g.code = k.code WHERE e = 0.1 AND m = 0.2 AND f = 0.25")
def snk12(spark, d):
    links = M.with_hits(techniques.sweep_links(D.pairs(spark, d), techniques.valid_cells(_grid(spark))), D.gold(spark, d))
    return S.links_of_cell(links, 0.1, 0.2, 0.25, valid_only=True)


# --- further modules -------------------------------------------------------------------------------------------

from linkloom import evolution_queries, io_queries, technique_queries  # noqa: E402, F401
