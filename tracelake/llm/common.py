"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.scratch import cut, release

__all__ = ["WHITE", "cut", "load", "release", "remainder", "schema_with"]

#: ASCII white space `[\x20\x09-\x0D]`, as a Java regex class.
WHITE = r"[\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n: the fold of a document; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def schema_with(df: DataFrame, more: dict[str, str]) -> T.StructType:
    """A frame's schema with further columns (name to type)."""
    return T.StructType([*df.schema.fields, *(T.StructField(c, T._parse_datatype_string(kind)) for c, kind in more.items())])
