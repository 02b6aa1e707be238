"""Sinks and the read-through result cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_itemset_report(table: DataFrame, path: str) -> None:
    """Lines like ``a + b: 12 (0.0123)``, by size and falling support."""
    line = F.format_string("%s: %d (%.4f)", "itemset", "n", "support")
    table.orderBy("size", F.desc("support"), "itemset").select(line.alias("value")).write.mode("overwrite").text(path)


def write_rules_report(rules: DataFrame, path: str) -> None:
    """A numbered block of lines a rule, by falling confidence and support; one file, as rules are few."""
    named = [("Support", "support"), ("Confidence", "confidence"), ("Lift", "lift"), ("Antecedent Support", "antecedent_support"), ("Consequent Support", "consequent_support")]
    order = [F.desc("confidence"), F.desc("support"), "antecedent", "consequent"]
    number = F.row_number().over(Window.orderBy(*order))
    head = F.format_string("%d. %s \u2192 %s", "number", "antecedent", "consequent")
    block = F.concat_ws("\n", head, *(F.format_string(f"   {label}: %.4f", column) for label, column in named), F.lit(""))
    rules.withColumn("number", number).orderBy("number").select(block.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_document(df: DataFrame, path: str, rows: int = 1000) -> None:
    """One JSON array of a small aggregate; more than ``rows`` rows are refused, as they would meet in one task."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"a document holds {rows} rows; write JSON lines instead")
    df.select(F.to_json(F.struct("*")).alias("j")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def write_console(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; the schema is inferred only if none is given."""
    return spark.read.option("header", True).csv(path, schema=schema, inferSchema=schema is None)


def _state(spark: SparkSession, file: str) -> str:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    return f"{file}:{status.getLen()}:{status.getModificationTime()}"


def cached(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as stored under ``folder`` by its plan and its input files (name, length, time), which it is written to at first."""
    spark = df.sparkSession
    files = "".join(_state(spark, f) for f in sorted(df.inputFiles()))
    mark = hashlib.sha256((df._jdf.queryExecution().analyzed().canonicalized().toString() + files).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{mark}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
