"""Sinks. A directory is only overwritten if it is the engine's own output path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def output_path(base: str, name: str, **keys: str) -> str:
    """base/name/key=value/..., the layout that partition pruning understands."""
    return "/".join([base.rstrip("/"), name, *(f"{k}={v}" for k, v in sorted(keys.items()))])


def reset_directory(spark: SparkSession, path: str) -> None:
    """An empty directory at the path, which must be one of the engine's own output paths."""
    if "/linkloom/" not in path:
        raise ValueError(f"not an output path of the engine: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    fs.mkdirs(at)


def write_csv(df: DataFrame, path: str, sep: str = ";", single: bool = False) -> None:
    """A CSV with header; `single` for reports of few rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_curve(curve: DataFrame, path: str, run: tuple[str, ...] = ()) -> None:
    """recall and precision, by recall, of each run."""
    curve.select(*run, "recall", "precision").orderBy(*run, "recall").coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def to_matrix(long: DataFrame, index: str = "req", column: str = "code", value: str = "sim", columns: list | None = None) -> DataFrame:
    """The wide matrix of a long table; stating the columns saves a pass."""
    g = long.groupBy(index)
    return (g.pivot(column, columns) if columns else g.pivot(column)).agg(F.first(value, ignorenulls=True))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode("overwrite").parquet(path)


def gold_lines(gold: DataFrame) -> DataFrame:
    """(value) req:code code ..., by requirement."""
    return gold.groupBy("req").agg(F.concat_ws(" ", F.sort_array(F.collect_set("code"))).alias("_c")).select(F.concat_ws(":", "req", "_c").alias("value"))


def nest_trace_pairs(sims: DataFrame) -> DataFrame:
    """(code_filename, code_element_list) rows, nested as trace pairs are kept in JSON."""
    a = sims.groupBy("code", "elem", "req").agg(F.collect_list(F.struct(F.col("part").alias("requirement_element"), F.col("sim").alias("similarity"))).alias("requirement_element_list"))
    b = a.groupBy("code", "elem").agg(F.collect_list(F.struct(F.col("req").alias("requirement_filename"), "requirement_element_list")).alias("requirement_list"))
    return b.groupBy(F.col("code").alias("code_filename")).agg(F.collect_list(F.struct(F.col("elem").alias("code_element"), "requirement_list")).alias("code_element_list"))


def threshold_grid(cells: DataFrame, value: str = "f1") -> DataFrame:
    """One row per (e, m), one column per f, as in a spreadsheet."""
    return cells.groupBy("e", "m").pivot("f").agg(F.first(F.round(value, 4)))


def text_lines(df: DataFrame, *cols: str, sep: str = " ") -> DataFrame:
    return df.select(F.concat_ws(sep, *cols).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def links_of_cell(links: DataFrame, e: float, m: float, f: float, valid_only: bool = False) -> DataFrame:
    """(req, code) of one cell of a sweep, all links or the valid ones."""
    out = links.filter((F.col("e") == e) & (F.col("m") == m) & (F.col("f") == f))
    return (out.filter("hit = 1") if valid_only else out).select("req", "code")
