"""The driver tables as a network: persons, accounts, transfers, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task beyond which a table is dealt over more tasks than the session's shuffles have.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A frame of about `rows` rows as it is, or dealt by its keys over as many tasks as these rows need, so that what a task holds doesn't grow with the input."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transfer: never aggregated. src, dst, amount, ts, seconds, evidence."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    many = dealt(li, li.count(), "l_orderkey")
    rows = many.join(o if many is li else o.hint("merge"), many.l_orderkey == o.o_orderkey)  # many orders aren't broadcast
    ts = F.col("l_shipdate").cast("timestamp")
    return rows.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.col("l_shipdate").alias("ts"), F.unix_timestamp(ts).alias("seconds"), F.col("l_orderkey").alias("evidence"), F.col("l_linenumber").alias("line"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per call: src, dst, ts, micros, duration, evidence."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("value").alias("duration"), F.col("event_id").alias("evidence"), "event_type")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their case (the region of their nation)."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.col("n_nationkey").alias("location"), F.col("n_regionkey").alias("case_id"))  # nation: 25 rows


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file as strings: delimiter sniffed, header names made unique, cells stripped, short rows padded."""
    import csv

    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())
    if sep is None:
        try:
            sep = csv.Sniffer().sniff(head, ",;\t|").delimiter
        except csv.Error:
            line = head.split("\n")[0]
            sep = max(",;\t|", key=line.count)
    first = next(csv.reader(head.lstrip("﻿").splitlines(), delimiter=sep), [])
    names, seen = [], {}
    for i, x in enumerate(first, 1):
        x = x.strip() or f"column_{i}"
        seen[x] = seen.get(x, -1) + 1
        names.append(f"{x}_{seen[x]}" if seen[x] else x)
    df = spark.read.csv(path, sep=sep, header=True, schema=", ".join(f"`c{i}` string" for i in range(len(names))), enforceSchema=True, multiLine=True, mode="PERMISSIVE")
    return df.select(*(F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(x) for i, x in enumerate(names)))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file with one JSON object a line, all top-level cells as strings (nested ones as JSON, null as empty); lines that
    aren't an object are skipped. The keys of all lines make the columns, by name; lines are split over tasks."""
    raw = spark.read.text(path).select(F.try_parse_json(F.trim("value")).alias("v"))
    cells = raw.select(F.from_json(F.to_json("v"), "map<string,string>").alias("m")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    names = sorted(r["k"] for r in cells.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())  # a table's columns
    return cells.select(*(F.coalesce(F.col("m")[k], F.lit("")).alias(k) for k in names))
