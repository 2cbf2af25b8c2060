"""Pattern detectors over time windows and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def structuring(transfers: DataFrame, least: int = 4, days: int = 30, under: float = 50_000, total: float = 1_000_000) -> DataFrame:
    """Pairs with `least` or more small transfers in a window whose total, large ones too, reaches `total`: the first such window."""
    ahead = Window.partitionBy("src", "dst").orderBy("seconds").rangeBetween(0, days * DAY)
    rows = transfers.withColumn("n", F.sum(F.when(F.col("amount") < under, 1).otherwise(0)).over(ahead)).withColumn("sum", F.round(F.sum("amount").over(ahead), 2))
    hits = rows.filter((F.col("n") >= least) & (F.col("sum") >= total))
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("seconds", "evidence", "line"))
    conf = 0.4 + 0.3 * F.least(F.lit(1.0), F.col("n") / F.lit(float(least))) + 0.3 * F.least(F.lit(1.0), F.col("sum") / F.lit(float(total)))
    return hits.withColumn("k", first).filter("k = 1").select("src", "dst", F.col("n").cast("long").alias("small_transfers"), F.col("sum").alias("window_total"), F.round(conf, 4).alias("confidence"), "seconds")


def burst(rows: DataFrame, keys: list[str], at: str, span: int, least: int) -> DataFrame:
    """Per key the largest window of `span` from an event on with `least` or more events; the first on ties."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(0, span))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), at))
    return rows.select(*keys, at).withColumn("n", n).filter(F.col("n") >= least).withColumn("k", best).filter("k = 1").select(*keys, F.col("n").alias("events"), F.col(at).alias("start"))


def phone_profile(calls: DataFrame) -> DataFrame:
    """Both directions: counterparties, calls, first and last."""
    both = calls.select(F.col("src").alias("phone"), F.col("dst").alias("other"), "micros").union(calls.select("dst", "src", "micros"))
    return both.groupBy("phone").agg(F.countDistinct("other").alias("counterparties"), F.count(F.lit(1)).alias("calls"), F.min("micros").alias("first"), F.max("micros").alias("last"))


def burner_phones(calls: DataFrame, days: float = 21, fan_out: int = 15) -> DataFrame:
    p = phone_profile(calls).withColumn("lifespan_days", F.round((F.col("last") - F.col("first")) / (DAY * 1e6), 4))
    return p.filter((F.col("lifespan_days") <= days) & (F.col("counterparties") >= fan_out)).select("phone", "counterparties", "calls", "lifespan_days")


def pair_counts(rows: DataFrame) -> DataFrame:
    """Events per unordered pair of different ends."""
    return rows.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def communication_anomalies(rows: DataFrame, least: int = 10, z: float = 2.0) -> DataFrame:
    """Pairs far over the mean count; mean and population deviation come from one aggregate row."""
    pairs = pair_counts(rows)
    stats = pairs.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    scored = pairs.crossJoin(F.broadcast(stats)).withColumn("z", F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")))  # one row
    return scored.filter((F.col("n") >= least) & (F.col("z") >= z)).select("a", "b", "n", F.round("z", 4).alias("z"))


def implied_speed(rows: DataFrame, key: str, at: Column, lat: str, lon: str, least: float = 110.0) -> DataFrame:
    """Consecutive sightings whose implied speed is `least` km/h or more."""
    from tracelake.functions.scalar import haversine_km

    w = Window.partitionBy(key).orderBy("_at", "id")
    r = rows.withColumn("_at", at).withColumn("p", F.lag(F.struct("_at", lat, lon, "id")).over(w)).filter("p is not null")
    km = haversine_km(F.col(f"p.{lat}"), F.col(f"p.{lon}"), F.col(lat), F.col(lon))
    hours = (F.col("_at") - F.col("p._at")) / 3600.0
    speed = F.when(hours > 0, km / hours)
    return r.select(key, F.col("p.id").alias("from_id"), F.col("id").alias("to_id"), F.round(km, 2).alias("km"), F.round(speed, 2).alias("kmh")).filter(F.col("kmh") >= least)
