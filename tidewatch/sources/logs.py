"""Sensor log readers, batch and continuous.

A text log is tab-separated; its ``#fields`` line names the columns, ``-`` is a missing value,
``(empty)`` an empty one, ``T``/``F`` are booleans and lists are comma-separated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.schemas import LOG_FIELDS, log_schema

_TEXT_OPTIONS = {"sep": "\t", "comment": "#", "nullValue": "-", "quote": "", "mode": "PERMISSIVE"}


def file_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Column order of every file, from its own ``#fields`` line. One distributed pass over the lines; one row per
    file comes back. A file with rows but no header, or with different headers, raises."""
    value = F.col("value")
    found = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
        .groupBy("file")
        .agg(
            F.min(F.when(value.startswith("#fields"), value)).alias("low"),
            F.max(F.when(value.startswith("#fields"), value)).alias("high"),
            F.count_if(~value.startswith("#") & (F.length("value") > 0)).alias("rows"),
        )
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in found:
        if r["low"] is None:
            if r["rows"]:
                raise ValueError(f"no #fields line in {r['file']}")
        elif r["low"] != r["high"]:
            raise ValueError(f"several #fields lines that differ in {r['file']}")
        else:
            out[unquote(r["file"])] = [_column(f) for f in r["low"].split("\t")[1:]]
    return out


def _column(field: str) -> str:
    return field.replace(".", "_")


def _typed(c: Column, data_type: str) -> Column:
    if data_type == "timestamp":
        return F.timestamp_micros(F.round(c.try_cast("decimal(26,7)") * 1000000).cast("bigint"))
    if data_type == "boolean":
        return F.when(c == "T", True).when(c == "F", False)
    if data_type.startswith("array<"):
        parts = F.when(c == "(empty)", F.array().cast("array<string>")).otherwise(F.split(c, ","))
        return parts.cast(data_type)
    if data_type == "string":
        return F.when(c == "(empty)", "").otherwise(c)
    return c.try_cast(data_type)


def _project(raw: DataFrame, log: str) -> DataFrame:
    """Typed, known fields only; a field the file does not carry is NULL."""
    return raw.select(
        *[
            (_typed(F.col(n), t) if n in raw.columns else F.lit(None).cast(t)).alias(n)
            for n, t in LOG_FIELDS[log].items()
        ]
    )


def _text_schema(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f.replace(".", "_"), T.StringType()) for f in fields])


def read_log(spark: SparkSession, path: str, log: str, fields: list[str] | None = None) -> DataFrame:
    """A completed log (file, folder or glob; gzip allowed). Every file is read by its own header, so files may
    differ in the order and number of their columns. ``fields`` skips looking at headers: all files have these."""
    if fields is not None:
        return _project(spark.read.csv(path, schema=_text_schema(fields), **_TEXT_OPTIONS), log)
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, names in file_headers(spark, path).items():
        layouts.setdefault(tuple(names), []).append(file)
    if not layouts:
        return spark.createDataFrame([], log_schema(log))
    parts = [
        # all files alike is the usual case: then the path is read as given
        _project(spark.read.csv(path if len(layouts) == 1 else files, schema=_text_schema(list(names)), **_TEXT_OPTIONS), log)
        for names, files in sorted(layouts.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def read_conn_log(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    return read_log(spark, path, "conn", fields)


def read_ssl_log(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    return read_log(spark, path, "ssl", fields)


def stream_log(
    spark: SparkSession,
    path: str,
    log: str,
    fields: list[str] | None = None,
    fmt: str = "text",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder that rotated logs keep arriving in; it may still be empty. Every text file is read by its own header,
    and as one row first, so a rotated file must fit in a task; one without a header stops the stream. ``fields`` skips
    headers: all files have these columns. ``fmt='parquet'`` reads already converted logs."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "parquet":
        return reader.schema(log_schema(log)).parquet(path)
    if fields is None:
        return _project(_by_own_header(reader.text(path, wholetext=True), log), log)
    for k, v in _TEXT_OPTIONS.items():
        reader = reader.option(k, v)
    return _project(reader.schema(_text_schema(fields)).csv(path), log)


def _by_own_header(files: DataFrame, log: str) -> DataFrame:
    """Rows of whole files, cells picked by the names in each file's header."""
    wanted = list(LOG_FIELDS[log])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                lines = [x.rstrip("\r") for x in text.split("\n")]
                header = next((x for x in lines if x.startswith("#fields")), None)
                cells = [x.split("\t") for x in lines if x and not x.startswith("#")]
                if header is None:
                    if cells:
                        raise ValueError("a log file without a #fields line")
                    continue
                place = {_column(f): k for k, f in enumerate(header.split("\t")[1:])}
                columns = []
                for name in wanted:
                    k = place.get(name, -1)
                    values = [None if k < 0 or k >= len(c) or c[k] == "-" else c[k] for c in cells]
                    columns.append(pa.array(values, type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=wanted)

    return files.mapInArrow(split, ", ".join(f"`{n}` string" for n in wanted))


def write_text_log(df: DataFrame, path: str, log: str, fields: list[str] | None = None, mode: str = "error") -> None:
    """Write a log in the text format above (hand-over to other tools; the inverse of ``read_log``). ``fields`` chooses
    columns and their order; one that the log does not know is written as text."""
    wanted = [n for n in (fields or LOG_FIELDS[log]) if n in df.columns]

    def as_text(n: str, t: str) -> Column:
        c = F.col(n)
        if t == "timestamp":
            text = (F.unix_micros(c.cast("timestamp")).cast("decimal(26,0)") / 1000000).cast("decimal(26,6)")
            text = text.cast("string")
        elif t == "boolean":
            text = F.when(c, "T").when(~c, "F")
        elif t.startswith("array<"):
            text = F.when(F.size(c) == 0, "(empty)").otherwise(F.array_join(c.cast("array<string>"), ","))
        elif t == "string":
            text = F.when(c == "", "(empty)").otherwise(c)
        else:
            text = c.cast("string")
        return F.coalesce(text, F.lit("-"))

    header = "#fields\t" + "\t".join(
        n.replace("id_orig_", "id.orig_").replace("id_resp_", "id.resp_") for n in wanted
    )
    cells: list[Column] = []
    for n in wanted:
        cells += [as_text(n, LOG_FIELDS[log].get(n, "string")), F.lit("\t")]
    lines = df.select(F.concat(*cells[:-1]).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    # every file begins with its header, as files of a sensor do
    lines.mapInArrow(headed, "value string").write.mode(mode).text(path)
