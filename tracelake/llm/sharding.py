"""Sharding by fixed virtual slots, with DataFrame functions only.

Every record is hashed into one of some thousands of virtual slots, whose number never changes. Bytes are
aggregated per slot, and slots, not records, are dealt to shards: the largest first, each to the shard
with the fewest bytes. The slot-to-shard map is a small table with versions, stored in a folder: a run
reads the last version and routes records by it. It is edited, and a new version stored, only where a
rebalance needs it: for more shards slots move to the new ones only; where sizes have drifted slots move
from the heaviest shards to the lightest until these are near equal again; for fewer shards the slots of
the removed ones go to the lightest that stay.

The law is `bytes`: shard sizes are near equal. Equal texts form a group and share a slot, so they stay
together, but for groups too large for near equal sizes. Such a group is *spread*: it gets SUB slots of
its own, to which its rows are hashed by doc_id. Spread groups are part of the stored map. Once spread, a
group stays so; one that must be newly spread starts with all its slots where it has been, and they move
as other slots do, so a row never moves between shards that were there before when shards are added.
Groups are spread only where slots as they are can't come within 1 %: groups of over 1, 1/2, 1/4 ... 1/32
of a shard's fair part are tried in turn, and the first that will do is taken (the best, if none does).
There are at most 32 of these for each shard, so their list is bounded.

- A size is the text's UTF-8 bytes plus 1; a null text has none plus 1 and belongs with the empty texts.
- Null ids: rows of a spread group without doc_id are spread by their place in the input.
- Repeated rows are records of their own. Ties in the order within a shard are broken by that place.
- Very long texts aren't read but for their length and hashes; one of over a fair part fills a shard.
- Empty tables give no row. Other columns are ignored.
- Two runs at once on one folder may both store the same next version; the later one stays.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.scratch import checkpoint_folder

from .common import cut

SLOTS = 4096
#: Slots of a spread group.
SUB = 256
#: A slot is numbered in parts of about this many rows.
PART_ROWS = 1 << 20
#: Groups of over this share of a shard's fair part are spread; the first share that comes within TOLERANCE is taken.
SHARES, TOLERANCE = (1, 1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32), 0.01


class SlotMap(NamedTuple):
    """A version of the map: the shard of every slot. First come the SLOTS common ones, then SUB for each spread group in the order of `spread`."""

    version: int
    shards: list[int]
    spread: list[str]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots


def loads_of(sizes: list[float], version: list[int], shards: int) -> list[float]:
    out = [0.0] * shards
    for size, shard in zip(sizes, version, strict=True):
        out[shard] += size
    return out


def assign(sizes: list[float], shards: int) -> list[int]:
    """The first version of the map: the largest slot first, each to the lightest shard, the lowest number on ties."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return out


def grow(sizes: list[float], version: list[int], shards: int) -> list[int]:
    """The next version of the map, for more shards: slots move only to new shards, from the heaviest one, the largest that doesn't overfill."""
    old, out = max(version, default=-1) + 1, list(version)
    loads = [0] * max(shards, old)
    held: list[list[int]] = [[] for _ in loads]
    for slot in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        loads[out[slot]] += sizes[slot]
        held[out[slot]].append(slot)
    fair = sum(sizes) / max(shards, 1)
    for new in range(old, shards):
        while True:
            donor = max(range(old), key=lambda s: (loads[s], -s))
            i = next((i for i in range(len(held[donor]) - 1, -1, -1) if 0 < sizes[held[donor][i]] <= fair - loads[new] and loads[donor] - sizes[held[donor][i]] >= fair * 0.98), None)
            if i is None:
                break
            slot = held[donor].pop(i)
            out[slot], loads[donor], loads[new] = new, loads[donor] - sizes[slot], loads[new] + sizes[slot]
            held[new].append(slot)
    return out


def rebalance(sizes: list[float], version: list[int], shards: int) -> list[int]:
    """The next version at the same number of shards: while the heaviest is over the tolerance, its largest slot that fits goes to the lightest."""
    out, fair = list(version), sum(sizes) / max(shards, 1)
    loads = loads_of(sizes, out, shards)
    while True:
        heavy, light = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        if loads[heavy] <= fair * (1 + TOLERANCE):
            return out
        fits = [i for i in range(len(sizes)) if out[i] == heavy and 0 < sizes[i] <= min(loads[heavy] - fair, fair - loads[light])]
        if not fits:
            return out
        slot = max(fits, key=lambda i: (sizes[i], -i))
        out[slot], loads[heavy], loads[light] = light, loads[heavy] - sizes[slot], loads[light] + sizes[slot]


def shrink(sizes: list[float], version: list[int], shards: int) -> list[int]:
    """The next version of the map, for fewer shards: the slots of the removed ones, the largest first, go to the lightest that stays."""
    out = list(version)
    loads = loads_of([size if at < shards else 0 for size, at in zip(sizes, out, strict=True)], [min(at, shards - 1) for at in out], shards)
    heap = [(load, at) for at, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted((i for i, at in enumerate(out) if at >= shards), key=lambda i: (-sizes[i], i)):
        load, at = heapq.heappop(heap)
        out[slot] = at
        heapq.heappush(heap, (load + sizes[slot], at))
    return out


def edit(sizes: list[float], version: list[int] | None, shards: int) -> list[int]:
    """The map for these sizes: a first one, or the given one with the edits that more shards, fewer shards or drifted sizes ask for."""
    if version is None:
        return assign(sizes, shards)
    if max(version) + 1 < shards:
        return grow(sizes, version, shards)
    return rebalance(sizes, shrink(sizes, version, shards) if max(version) >= shards else version, shards)


def last_version(spark: SparkSession, folder: str) -> SlotMap | None:
    """The last version stored in a folder, if there is one."""
    try:
        stored = spark.read.parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    last = stored.filter(F.col("version") == stored.agg(F.max("version")).first()[0]).orderBy("virtual_slot").collect()  # a row per slot
    return SlotMap(int(last[0]["version"]), [r["shard"] for r in last], [r["spread_group"] for r in last[SLOTS::SUB]])


def store(spark: SparkSession, folder: str, new: SlotMap) -> None:
    """Stores the version after the last complete one."""
    rows = [(slot, at, None if slot < SLOTS else new.spread[(slot - SLOTS) // SUB]) for slot, at in enumerate(new.shards)]
    spark.createDataFrame(rows, "virtual_slot long, shard int, spread_group string").coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/version={new.version}")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, row (a number in the input) and the digest of the text that its group shares."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"), F.monotonically_increasing_id().alias("row"))


def with_slots(rows: DataFrame, spread: list[str]) -> DataFrame:
    """Records with their virtual slots: the group's one, or one of a spread group's own by doc_id."""
    common = slot_of(F.col("group"))
    if not spread:
        return rows.withColumn("virtual_slot", common)
    places = rows.sparkSession.createDataFrame(list(enumerate(spread)), "place long, group string")
    own = SLOTS + F.col("place") * SUB + slot_of(F.concat_ws(":", "group", F.coalesce(F.col("doc_id"), F.col("row")).cast("string")), SUB)
    return rows.join(F.broadcast(places), "group", "left").withColumn("virtual_slot", F.coalesce(own, common)).drop("place")  # 32 groups per shard at most


def totals(rows: DataFrame, spread: list[str]) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: two numbers for each of the fixed slots."""
    got = {r["virtual_slot"]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    at = range(SLOTS + SUB * len(spread))
    return [got[i]["size"] if i in got else 0 for i in at], [got[i]["n"] if i in got else 0 for i in at]


def to_spread(base: DataFrame, sizes: list[int], last: SlotMap | None, shards: int) -> list[str]:
    """The groups that have to be spread, besides those that are, for near equal sizes: those of the first share whose edited map is within the tolerance."""
    fair = sum(sizes) / shards
    within = lambda sizes, version: max(loads_of(sizes, edit(sizes, version, shards), shards))
    best: tuple[float, list[str]] = (within(sizes, last.shards if last else None), [])
    if best[0] <= (1 + TOLERANCE) * fair:
        return []
    groups = base.filter(~F.col("group").isin(last.spread)) if last and last.spread else base
    groups = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter((F.col("n") > 1) & (F.col("size") > int(fair * SHARES[-1])))
    large = sorted(((r["size"], r["group"], r["slot"]) for r in groups.withColumn("slot", slot_of(F.col("group"))).collect()), reverse=True)  # 32 groups per shard at most
    for share in SHARES:
        chosen = [x for x in large if x[0] > share * fair]
        if len(chosen) == len(best[1]):
            continue
        trial, version = list(sizes), list(last.shards) if last else None
        for size, _, home in chosen:
            trial[home] -= size
            trial += [size / SUB] * SUB
            if version is not None:
                version += [version[home]] * SUB
        most = within(trial, version)
        if most < best[0]:
            best = (most, [group for _, group, _ in chosen])
        if most <= (1 + TOLERANCE) * fair:
            break
    return best[1]


def home_of(group: str) -> int:
    """`slot_of` a group, on the driver."""
    return int(hashlib.md5(group.encode()).hexdigest()[:8], 16) % SLOTS


def current_map(spark: SparkSession, folder: str, base: DataFrame, shards: int) -> tuple[SlotMap, list[int], list[int]]:
    """The map for these records, with bytes and rows per slot: the last version as it is, or edited and stored as the next one."""
    last = last_version(spark, folder)
    spread = list(last.spread) if last else []
    sizes, counts = totals(with_slots(base, spread), spread)
    version = list(last.shards) if last else None
    if more := to_spread(base, sizes, last, shards):
        spread += more
        sizes, counts = totals(with_slots(base, spread), spread)
        if version is not None:
            version += [version[home_of(group)] for group in more for _ in range(SUB)]
    now = SlotMap(last.version if last else 0, edit(sizes, version, shards), spread)
    if last is None or (now.shards, now.spread) != (last.shards, last.spread):
        now = now._replace(version=now.version + 1)
        store(spark, folder, now)
    return now, sizes, counts


def shard(docs: DataFrame, shards: int = 8, folder: str | None = None) -> DataFrame:
    """One row per document: its shard, and its place in the shard (`slot`, gapless from 0). Also its virtual slot and the shard that this slot would have if
    one more were added. The map is read from and stored in `folder`; by default one of the run's own under the checkpoint folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    base = cut(records(docs))
    now, sizes, counts = current_map(spark, folder, base, shards)
    grown = grow(sizes, now.shards, shards + 1)
    both = spark.createDataFrame([(slot, n, a, b) for slot, (n, a, b) in enumerate(zip((1 + n // PART_ROWS for n in counts), now.shards, grown, strict=True))], "virtual_slot long, parts long, shard int, next_shard int")
    placed = with_slots(base, now.spread).join(F.broadcast(both), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))  # one row per slot
    per = placed.groupBy("virtual_slot", "part", "shard").agg(F.count(F.lit(1)).alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part, so rows / PART_ROWS beyond one per slot
    before = per.select("virtual_slot", "part", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("before"))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "row")) - 1)
    return ranked.join(before, ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard"
    )


def map_folder(spark: SparkSession, table: str) -> str:
    """Where the map of a table lies: a folder named by the table, so that every run reads the version before it."""
    return f"{checkpoint_folder(spark).rstrip('/')}/slot-map-{hashlib.sha256(table.encode()).hexdigest()[:16]}"
