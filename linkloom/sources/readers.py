"""Readers of artefacts, gold sets, scores, graphs and vectors. Every schema is stated; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import file_name, stem
from linkloom.functions.vectors import unit

TRACE_PAIRS = "code_file_list array<struct<code_filename:string,code_element_list:array<struct<code_element:string,requirement_list:array<struct<requirement_filename:string,requirement_element_list:array<struct<requirement_element:string,similarity:double>>>>>>>>"
EMBEDDING = "file_path string, vector array<double>, sub_vectors array<array<double>>"
CALL_GRAPH = "map<string,struct<calls:array<array<string>>,called_by:array<array<string>>,class_name:string,method_name:string,params:array<string>>>"
ISSUES = "entries array<struct<issueid:string,attributes:struct<summary:string,description:string>,code:array<struct<filename:string>>,children:map<string,array<string>>>>"
LABELLED = "requirement string, code_entry string, valid int, requirement_filename string, code_filename string, dataset string"
EVAL = "e double, m double, f double, found long, hits long, gold long, precision double, recall double, f1 double"


def files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, file_name, stem, length) of all files below a directory, without their contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return f.select("path", file_name(F.col("path")).alias("file_name"), stem(file_name(F.col("path"))).alias("stem"), "length")


def texts(spark: SparkSession, directory: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """(path, file_name, stem, content) of whole files, without a byte order mark."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    text = F.col("content").cast("string") if encoding.upper() == "UTF-8" else F.decode("content", encoding)
    content = F.regexp_replace(text, "^\ufeff", "")
    return f.select("path", file_name(F.col("path")).alias("file_name"), stem(file_name(F.col("path"))).alias("stem"), content.alias("content"))


def lines(df: DataFrame, text_col: str = "content") -> DataFrame:
    """df with pos and line instead of the text, one row per line."""
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n", -1)).alias("pos", "line"))


def csv(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ";", header: bool = True) -> DataFrame:
    """Rows of one or more files with a header each; with header=False the schema names the columns."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(paths)


def csv_renamed(spark: SparkSession, path: str, header: list[str], sep: str = ";") -> DataFrame:
    """A CSV whose own header is replaced."""
    return csv(spark, path, ", ".join(f"`{h}` string" for h in header), sep)


def matrix(spark: SparkSession, path: str, sep: str = ";", value: str = "sim") -> DataFrame:
    """(req, code, value) of a matrix with an index column; its header row names the codes."""
    head = spark.read.text(path).first()[0].split(sep)
    wide = csv(spark, path, ", ".join(["req string", *(f"`{h}` double" for h in head[1:])]), sep)
    return wide.unpivot(["req"], [f"`{h}`" for h in head[1:]], "code", value)


def similarity_matrix(spark: SparkSession, path: str, invert: bool = False, extension: str | None = None) -> DataFrame:
    """A similarity matrix, as 1 - sim where it holds distances, code names with another extension if named."""
    m = matrix(spark, path)
    m = m.withColumn("sim", 1 - F.col("sim")) if invert else m
    return m.withColumn("code", F.concat(stem(F.col("code")), F.lit(f".{extension}"))) if extension else m


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def gold_xml(spark: SparkSession, path: str) -> DataFrame:
    """(req, code) of <link> elements: their first and last child."""
    doc = spark.read.text(path, wholetext=True)
    nodes = lambda which: F.expr(f"xpath(value, '//link/*[{which}]/text()')")
    return doc.select(F.explode(F.arrays_zip(nodes("1").alias("req"), nodes("last()").alias("code"))).alias("x")).select("x.req", "x.code").distinct()


def gold_text(df: DataFrame, delimiter: str = ":", req_ext: str | None = None, code_ext: str | None = None, duplicates: bool = False) -> DataFrame:
    """(req, code) of lines req:code1 code2; lines without the delimiter are left out."""
    parts = F.split("value", f"\\Q{delimiter}\\E", 2)
    rows = df.filter(F.col("value").contains(delimiter)).select(F.trim(parts[0]).alias("req"), F.explode(F.split(F.trim(parts[1]), r"\s+", -1)).alias("code")).filter("code <> ''")
    if req_ext:
        rows = rows.withColumn("req", F.concat(stem(F.col("req")), F.lit(f".{req_ext}")))
    if code_ext:
        rows = rows.withColumn("code", F.concat(stem(F.col("code")), F.lit(f".{code_ext}")))
    return rows if duplicates else rows.distinct()


def third_party_scores(df: DataFrame, header_lines: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """(req, code, sim) of lines 'req code sim' after a header, from (pos, line): no package, extensions in lower case, .jsp and .txt names bare."""
    p = F.split(F.trim("line"), r"\s+", -1)
    name = lambda c: F.concat(stem(c), F.lower(F.regexp_extract(c, r"(\.[^.]*)$", 1)))
    bare = lambda c: F.regexp_replace(c, r"\.(jsp|txt)$", "")
    code = F.regexp_replace(p[1], r"^.*\.(?=[^.]+\.[^.]+$)", "")
    rows = df.filter((F.col("pos") >= header_lines) & (F.size(p) == 3))
    return rows.select(*keep, bare(name(p[0])).alias("req"), bare(name(code)).alias("code"), p[2].cast("double").alias("sim"))


def trace_pairs(df: DataFrame) -> DataFrame:
    """(code, elem, req, part, sim) of the nested trace pairs."""
    a = df.select(F.explode("code_file_list").alias("c")).select("c.code_filename", F.explode("c.code_element_list").alias("e"))
    b = a.select("code_filename", "e.code_element", F.explode("e.requirement_list").alias("r"))
    return b.select(F.col("code_filename").alias("code"), F.col("code_element").alias("elem"), F.col("r.requirement_filename").alias("req"), F.explode("r.requirement_element_list").alias("x")).select(
        "code", "elem", "req", F.col("x.requirement_element").alias("part"), F.col("x.similarity").alias("sim")
    )


def embeddings(df: DataFrame) -> DataFrame:
    """(file, pos, vec) of stored embeddings; the vector of the file itself has position -1."""
    return df.select(F.col("file_path").alias("file"), F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.col("vector").alias("vec"))), F.transform(F.coalesce("sub_vectors", F.array().cast("array<array<double>>")), lambda v, i: F.struct(i.alias("pos"), v.alias("vec"))))).alias("x")).select("file", "x.pos", "x.vec")


def embeddings_at_hand(df: DataFrame, file: str, pos: str, vec: str) -> DataFrame:
    """(file, pos, vec) of a table of embeddings, as embeddings() gives them from storage."""
    return df.select(F.col(file).cast("string").alias("file"), F.col(pos).alias("pos"), F.col(vec).alias("vec"))


def call_graph(df: DataFrame, graph_col: str = "graph") -> tuple[DataFrame, DataFrame]:
    """(nodes (node, class_name, method_name, params), edges (caller, callee)) of a method call graph kept as a map."""
    n = df.select(F.explode(graph_col).alias("node", "x"))
    nodes = n.select("node", "x.class_name", "x.method_name", "x.params")
    key = lambda c: F.concat_ws(".", c)
    out = n.select(F.col("node").alias("caller"), F.explode("x.calls").alias("c")).select("caller", key(F.col("c")).alias("callee"))
    back = n.select(F.explode("x.called_by").alias("c"), F.col("node").alias("callee")).select(key(F.col("c")).alias("caller"), "callee")
    return nodes, out.unionByName(back).distinct()


def word_vectors(df: DataFrame) -> DataFrame:
    """(word, vec) at length 1 of a table of word vectors (word, vec)."""
    return df.select("word", unit(F.col("vec").cast("array<double>")).alias("vec"))


def word_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of a .vec text file: a header line, then a word and its components in each line."""
    p = F.split("value", " ", -1)
    rows = spark.read.text(path).filter(F.size(p) > 2)
    return word_vectors(rows.select(p[0].alias("word"), F.transform(F.filter(F.slice(p, 2, 100_000), lambda x: x != ""), lambda x: x.cast("double")).alias("vec")))


def file_names(df: DataFrame) -> DataFrame:
    """(file_name, stem) of the lines of a name list."""
    return df.select(F.trim("value").alias("file_name")).filter("file_name <> ''").withColumn("stem", stem(F.col("file_name"))).distinct()
