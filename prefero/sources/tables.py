"""Reading decision tables: one row per decision-maker, one column per alternative and attribute."""

from __future__ import annotations

import csv
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc", ".dat": "spaced", ".txt": "spaced"}


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A table by its suffix, or by ``fmt``: csv, parquet, json, orc or spaced (fields between white space or commas).

    An unknown suffix is read as csv.  A missing path raises FileNotFoundError.
    Excel files are not read in a distributed way: convert them first.
    """
    kind = fmt or FORMATS.get(PurePath(path).suffix.lower(), "csv")
    try:
        if kind == "csv":
            return spark.read.csv(path, header=True, inferSchema=True)
        if kind == "spaced":
            return _spaced(spark, path)
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def _spaced(spark: SparkSession, path: str) -> DataFrame:
    """Lines whose fields stand between commas, if the first line has one, else between white space; the first line names the columns.

    White space around a line and a field does not count, nor how much of it stands between fields; a field in
    double quotes may hold separators.  An empty field is null.  A line of more or fewer fields than there are
    names stops the job that meets it.  A column is long or double if all its values are, else a
    string; whole numbers with leading zeros stay text, as they are names and not amounts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    first = lines.select("value").first()
    if first is None:
        return spark.createDataFrame([], "value string")
    header, sep = first[0], "," if "," in first[0] else "\t"
    # of white space between fields, not of that inside quotes, one tab is left
    clean = F.regexp_replace("value", r"^\s+|\s+$", "")
    clean = clean if sep == "," else F.regexp_replace(clean, r'\s+(?=(?:[^"]*"[^"]*")*[^"]*$)', "\t")
    names = [n.strip() for n in next(csv.reader([lines.where(F.col("value") == header).select(clean).first()[0]], delimiter=sep, skipinitialspace=True))]
    schema = ", ".join(f"f{i} string" for i in range(len(names)))
    how = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    # each file begins with the header: in it the first such line goes, and a row that equals the header stays
    heads = lines.where((F.col("block") == 0) & (F.col("value") == header)).groupBy("file").agg(F.min("n").alias("n"))
    rows = lines.join(heads, ["file", "n"], "left_anti").select(F.from_csv(clean, schema, how).alias("f"))
    rows = rows.select(*[F.when(F.col(f"f.f{i}") != "", F.col(f"f.f{i}")).alias(n) for i, n in enumerate(names)])
    fits = lambda n, kind: F.col(f"`{n}`").isNull() | F.expr(f"try_cast(`{n}` AS {kind})").isNotNull() & ~F.col(f"`{n}`").rlike("^[+-]?0[0-9]")
    kinds = rows.agg(*[F.coalesce(F.bool_and(fits(n, k)), F.lit(False)).alias(f"{k}{i}") for i, n in enumerate(names) for k in ("long", "double")]).first()
    kind = lambda i: "long" if kinds[f"long{i}"] else "double" if kinds[f"double{i}"] else "string"
    return rows.select(*[F.col(f"`{n}`").cast(kind(i)).alias(n) for i, n in enumerate(names)])
