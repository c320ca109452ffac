"""Read any supported file by its ending, and convert between formats."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# File endings and the reader each one uses. Lake formats go
# through the same call when their connector is on the classpath.
FORMATS = {
    ".csv": "csv", ".tsv": "csv", ".txt": "text", ".json": "json", ".jsonl": "json", ".ndjson": "json",
    ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".avro": "avro",
}
OPTIONS = {"csv": {"header": "true"}}


def format_of(path: str) -> str:
    """Reader name for a path; unknown endings are read as bytes."""
    name = path.lower().removesuffix(".gz").removesuffix(".zst")
    return FORMATS.get(os.path.splitext(name)[1], "binaryFile")


def read_file(
    spark: SparkSession, path: str | list[str], schema: StructType | None = None, fmt: str | None = None, **options
) -> DataFrame:
    """Read files, globs or lists of files; ``schema`` avoids an inference pass."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or format_of(first)
    opts = {**OPTIONS.get(fmt, {}), **options}
    if first.lower().endswith(".tsv"):
        opts.setdefault("sep", "\t")
    reader = spark.read.format(fmt).options(**opts)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def convert(spark: SparkSession, source: str, source_format: str, target: str, target_format: str) -> DataFrame:
    """Rewrite a folder in another format and return the result."""
    df = read_file(spark, source, fmt=source_format)
    df.write.format(target_format).options(**OPTIONS.get(target_format, {})).save(target)
    return read_file(spark, target, fmt=target_format)
