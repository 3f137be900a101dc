"""Read input tables; write tidy results and snapshots."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import NA_TOKENS
from autostat.sources.csv_records import records

READERS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def missing_to_null(df: DataFrame) -> DataFrame:
    """Missing-value words in text and NaN in numbers become NULL."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            changed[f.name] = F.when(~F.col(f.name).isin(*NA_TOKENS), F.col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changed[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
    return df.withColumns(changed) if changed else df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", quoted_newlines: bool = True
) -> DataFrame:
    """Header row; types from `schema`, or inferred after missing-value words are set aside.

    Cells in quotes may hold line breaks, and a file is still read by many tasks (see `csv_records`); where it is known
    that none do, `quoted_newlines=False` saves the pass that looks for them. Without a schema all cells are read as text
    and one aggregate finds the columns whose every remaining cell is a number; pass a schema for large files to save
    that pass.
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"'}
    # The first record names the columns; a file is opened by the driver for no more than that.
    names = spark.read.options(**options, multiLine=True).csv(path).columns if quoted_newlines else []
    if not quoted_newlines:
        reader = spark.read.options(**options)
        text = missing_to_null((reader if schema is None else reader.schema(schema)).csv(path))
    elif not names:
        return spark.read.options(**options, multiLine=True).csv(path)
    else:
        fields = T.StructType([T.StructField(c, T.StringType()) for c in names]) if schema is None else schema
        fields = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
        parsed = F.from_csv("record", fields.toDDL(), {k: str(v) for k, v in options.items() if k != "header"})
        text = missing_to_null(records(spark, path, sep).select(parsed.alias("c")).select("c.*"))
    if schema is not None:
        return text
    tests = []
    for c in text.columns:
        whole = F.col(c).try_cast("long").isNotNull() & F.col(c).rlike(r"^\s*[+-]?\d+\s*$")
        tests += [
            F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()),
            F.count_if(F.col(c).isNotNull() & ~whole),
            F.count_if(F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c))).isin("true", "false")),
            F.count(c),
        ]
    found = text.select(*tests).first()
    cast = []
    for i, c in enumerate(text.columns):
        bad_number, bad_whole, bad_flag, present = found[4 * i : 4 * i + 4]
        if present and not bad_whole:
            cast.append(F.col(c).try_cast("long").alias(c))
        elif not present or not bad_number:
            cast.append(F.col(c).try_cast("double").alias(c))
        elif not bad_flag:
            cast.append(F.col(c).try_cast("boolean").alias(c))
        else:
            cast.append(F.col(c))
    return text.select(*cast)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Reader by file extension; a name without a path separator or extension is a catalog table.

    Missing-value words are a convention of CSV files; typed sources are read as they are, so that filters reach
    the scan. NaN is set aside where a number is used."""
    ext = os.path.splitext(path.rstrip("/").lower())[1]
    if not ext and "/" not in path:
        return spark.table(path)
    if ext not in READERS:
        raise ValueError(f"unsupported format '{ext}'; use one of {', '.join(sorted(READERS))}")
    if READERS[ext] == "csv":
        return read_csv(spark, path, schema, "\t" if ext == ".tsv" else ",")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(READERS[ext]).load(path)


def snapshot(df: DataFrame, base: str, run_id: str) -> DataFrame:
    """Store the input of a run once, so that it can be repeated; returns the stored table."""
    path = f"{base}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_parameters(spark: SparkSession, request: object) -> DataFrame:
    """(parameter, value): every field of an analysis request, as text; what is not set is NULL."""
    rows = []
    for f in dataclasses.fields(request):
        value = getattr(request, f.name)
        if isinstance(value, (list, tuple)):
            value = ", ".join(map(str, value))
        rows.append((f.name, None if value is None else str(value)))
    return spark.createDataFrame(rows, "parameter string, value string")


def write_results(
    results: dict[str, DataFrame], base: str, run_id: str, partition_by: Sequence[str] = (), request: object | None = None
) -> None:
    """Append every tidy result table under `base/<name>`, partitioned by run (and by the given columns); with the
    `request`, its parameters as table `run_parameters`."""
    if request is not None:
        spark = next(iter(results.values())).sparkSession
        results = {**results, "run_parameters": run_parameters(spark, request)}
    for name, table in results.items():
        extra = [c for c in partition_by if c in table.columns]
        stamped = table.withColumn("run_id", F.lit(run_id))
        stamped.write.mode("append").partitionBy("run_id", *extra).parquet(f"{base}/{name}")
