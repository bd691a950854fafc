"""The operators' inputs as views over the driver's tables, in Spark and, word for word, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.similarity import cosine_pairs
from linkloom.runtime import load


def elem(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as parts of files: 20 to a file, every fifth of the requirement's side."""
    e = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 20).cast("long").alias("file"), (F.col("vec_id") % 5 == 0).alias("is_req"), F.col("embedding").cast("array<double>").alias("vec"))


def code_elements(spark: SparkSession, d: str) -> DataFrame:
    return elem(spark, d).filter("not is_req").select(F.col("file").alias("code"), F.col("id").alias("elem"), "vec")


def req_parts(spark: SparkSession, d: str) -> DataFrame:
    return elem(spark, d).filter("is_req").select(F.col("file").alias("req"), F.col("id").alias("part"), "vec")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return cosine_pairs(code_elements(spark, d), req_parts(spark, d))


def gold(spark: SparkSession, d: str) -> DataFrame:
    f = elem(spark, d).select("file").distinct()
    both = f.select(F.col("file").alias("req")).join(F.broadcast(f.select(F.col("file").alias("code"))))
    return both.filter((F.col("req") * 7 + F.col("code") * 3) % 5 == 0)


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    e = elem(spark, d)
    n = e.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    c = e.filter("not is_req").withColumn("k", F.lit(1)).join(F.broadcast(n), "k").select(F.col("id").alias("caller"), ((F.col("id") * 7 + 1) % F.col("n")).alias("callee"))
    return c.filter("callee % 5 <> 0 and caller <> callee")


def inherits(spark: SparkSession, d: str) -> DataFrame:
    f = elem(spark, d).select("file").distinct().filter("file > 0")
    return f.select(F.col("file").alias("sub"), F.floor(F.col("file") / 2).cast("long").alias("super"))


def trace_gold(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "trace_link").filter("req_filename is not null and code_filename is not null")
    return t.select(F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code")).distinct()


def trace_scores(spark: SparkSession, d: str) -> DataFrame:
    """(tool, req, code, sim): the best score of each pair by each tool, without null and NaN."""
    s = load(spark, d, "trace_score").filter("score is not null and not isnan(score) and req_filename is not null and code_filename is not null")
    return s.groupBy(F.coalesce("tool", F.lit("")).alias("tool"), F.lower("req_filename").alias("req"), F.lower("code_filename").alias("code")).agg(F.max("score").alias("sim"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """(method_id, t): class name, method name and parameter types of every method."""
    m = load(spark, d, "code_method").select("method_id", "class_name", "method_name", "params").dropDuplicates(["method_id"])
    empty = F.array().cast("array<string>")
    return m.select("method_id", F.filter(F.concat(F.array("class_name", "method_name"), F.coalesce("params", empty)), lambda x: x.isNotNull()).alias("t"))


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", " ", -1).alias("t"))


def requirement_texts(spark: SparkSession, d: str) -> DataFrame:
    """(req, text): the text of the record delivered first of each requirement file."""
    r = load(spark, d, "issue_entry").filter("req_filename is not null and req_text is not null").select(F.lower("req_filename").alias("req"), "req_id", "req_text")
    return r.groupBy("req").agg(F.min_by("req_text", "req_id").alias("text"))


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    """(file, word) of the words of all documents in any script, with repetition."""
    t = load(spark, d, "documents").filter("text is not null")
    return t.select(F.col("doc_id").alias("file"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)).alias("word"))


def part_words(spark: SparkSession, d: str) -> DataFrame:
    """(part, word): lower-cased words of the requirement texts, with repetition, part = record."""
    r = load(spark, d, "issue_entry").select("req_id", "req_text").filter("req_id is not null and req_text is not null").dropDuplicates(["req_id"])
    return r.select(F.col("req_id").alias("part"), F.explode(F.regexp_extract_all(F.lower("req_text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("word"))


def word_vec(spark: SparkSession, d: str) -> DataFrame:
    """(word, vec): every word of the method names has the vector of a row of embeddings."""
    return vectors_of(method_words(spark, d).select("word").distinct(), spark, d)


def vectors_of(w: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """(word, vec): words get the vectors of all rows of embeddings by a rule; some words have none."""
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = e.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    rows = w.withColumn("k", F.lit(1)).join(F.broadcast(n), "k").withColumn("vec_id", (F.ascii("word") * 31 + F.length("word") * 7 + F.ascii(F.reverse("word")) * 13).cast("long") % F.col("n")).filter("vec_id % 11 <> 0")
    return rows.join(e, "vec_id").select("word", "vec")


def method_words(spark: SparkSession, d: str) -> DataFrame:
    """(file, elem, word): lower-cased camel-case words of method names, file = class."""
    m = load(spark, d, "code_method").select("method_id", "class_name", "method_name").dropDuplicates(["method_id"]).filter("method_name is not null and class_name is not null")
    return m.select(F.col("class_name").alias("file"), F.col("method_id").alias("elem"), F.explode(F.regexp_extract_all("method_name", F.lit("([A-Z]?[a-z]+)"), 1)).alias("word")).withColumn("word", F.lower("word"))


SQL = """
elem AS (SELECT vec_id AS id, vec_id // 20 AS file, vec_id % 5 = 0 AS is_req, embedding::DOUBLE[] AS vec FROM embeddings),
code_el AS (SELECT file AS code, id AS elem, vec FROM elem WHERE NOT is_req), req_el AS (SELECT file AS req, id AS part, vec FROM elem WHERE is_req),
pairs AS (SELECT code, elem, req, part, list_dot_product(c.vec, r.vec) / sqrt(list_dot_product(c.vec, c.vec) * list_dot_product(r.vec, r.vec)) AS sim FROM code_el c, req_el r),
files AS (SELECT DISTINCT file FROM elem), gold AS (SELECT a.file AS req, b.file AS code FROM files a, files b WHERE (a.file * 7 + b.file * 3) % 5 = 0),
cg AS (SELECT * FROM (SELECT id AS caller, (id * 7 + 1) % (SELECT count(*) FROM elem) AS callee FROM elem WHERE NOT is_req) WHERE callee % 5 <> 0 AND caller <> callee),
inh AS (SELECT file AS sub, file // 2 AS super FROM files WHERE file > 0)
"""
TRACE_SQL = """
gold AS (SELECT DISTINCT lower(req_filename) AS req, lower(code_filename) AS code FROM trace_link WHERE req_filename IS NOT NULL AND code_filename IS NOT NULL),
scores AS (SELECT coalesce(tool, '') AS tool, lower(req_filename) AS req, lower(code_filename) AS code, max(score) AS sim FROM trace_score WHERE score IS NOT NULL AND NOT isnan(score) AND req_filename IS NOT NULL AND code_filename IS NOT NULL GROUP BY 1, 2, 3),
hits AS (SELECT s.*, CASE WHEN g.req IS NULL THEN 0 ELSE 1 END AS hit FROM scores s LEFT JOIN gold g USING (req, code))
"""
IDENT_SQL = "ident AS (SELECT method_id, list_filter([any_value(class_name), any_value(method_name)] || coalesce(any_value(params), []), lambda x: x IS NOT NULL) AS t FROM code_method GROUP BY method_id)"
TOKENS_SQL = "toks AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL)"
WORDS_SQL = "dw AS (SELECT doc_id AS file, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) AS word FROM documents WHERE text IS NOT NULL)"
METHOD_SQL = """
meth AS (SELECT method_id, any_value(class_name) AS file, any_value(method_name) AS mn FROM code_method GROUP BY method_id),
mw AS (SELECT file, method_id AS elem, lower(unnest(regexp_extract_all(mn, '[A-Z]?[a-z]+'))) AS word FROM meth WHERE file IS NOT NULL AND mn IS NOT NULL),
wv AS (SELECT word, embedding::DOUBLE[] AS vec FROM (SELECT DISTINCT word, (ascii(word) * 31 + length(word) * 7 + ascii(reverse(word)) * 13) % (SELECT count(*) FROM embeddings) AS vec_id FROM mw) JOIN embeddings USING (vec_id) WHERE vec_id % 11 <> 0)
"""
