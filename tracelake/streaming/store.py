"""A keyed merge kept up by a stream: every batch leaves its own folded part, and what a key is follows from all parts.

Layout under the store's folder, which the driver and all executors must share: `values/batch=N` and `items/batch=N` per
batch, `values/base=N` and `items/base=N` for all batches up to N together. A part counts once its files are complete.
A batch that comes again replaces its own part, or is left alone if a base holds it, so it changes nothing. A batch is folded before
it is written and parts hold a row per key, so no state is bound to a task and a hot key costs no more than another.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tracelake.operators import entities as E


class EntityStore:
    """Merges records of (keys, seq, columns of `rules`) under `folder`; rules as in `operators.entities`. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], seq: str, rules: dict[str, str]):
        self.spark, self.folder, self.keys, self.seq, self.rules = spark, folder.rstrip("/"), keys, seq, rules
        self.has_items = "union" in rules.values()

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[tuple[str, int]]:
        """The parts of a kind ('base' or 'batch') that are whole, items being written before values."""
        at, fs = self._path("values")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = [(n, int(n.split("=")[1])) for n in names if re.fullmatch(f"{kind}=[0-9]+", n)]
        return sorted(((n, i) for n, i in found if fs.exists(self._path(f"values/{n}/_SUCCESS")[0])), key=lambda x: x[1])

    def _base(self) -> int:
        return max((i for _, i in self._complete("base")), default=-1)

    def _live(self) -> list[str]:
        base = self._base()
        return [f"base={base}"] * (base >= 0) + [n for n, i in self._complete("batch") if i > base]

    def _write(self, name: str, values: DataFrame, items: DataFrame | None) -> None:
        if self.has_items:
            items.write.mode("overwrite").parquet(f"{self.folder}/items/{name}")
        values.write.mode("overwrite").parquet(f"{self.folder}/values/{name}")

    def add(self, records: DataFrame, batch: int) -> None:
        """Folds a batch into its part; as `foreachBatch` calls it."""
        if batch <= self._base():
            return
        values = E.fold(E.begin(records, self.keys, self.seq, self.rules), self.keys, self.rules)
        items = E.fold_items(E.begin_items(records, self.keys, self.seq, self.rules), self.keys) if self.has_items else None
        self._write(f"batch={batch}", values, items)

    def _read(self, what: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.folder}/{what}/{n}") for n in self._live()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def values(self) -> DataFrame | None:
        """One row per key with its merged values, None before the first batch."""
        parts = self._read("values")
        return None if parts is None else E.finish(E.fold(parts, self.keys, self.rules), self.keys, self.rules)

    def items(self) -> DataFrame | None:
        """The items of all arrays (keys, field, item, first seq), None before the first batch."""
        parts = self._read("items") if self.has_items else None
        return None if parts is None else E.fold_items(parts, self.keys)

    def compact(self) -> int:
        """Puts all parts into one base and returns the last batch that it holds. The older parts stay for those who read them, until `sweep`."""
        live = self._complete("batch")
        last, base = max((i for _, i in live), default=-1), self._base()
        if last > base:
            items = E.fold_items(self._read("items"), self.keys) if self.has_items else None
            self._write(f"base={last}", E.fold(self._read("values"), self.keys, self.rules), items)
        return max(last, base)

    def sweep(self) -> None:
        """Deletes the parts that the newest base holds."""
        base = self._base()
        for name, i in self._complete("base") + self._complete("batch"):
            if i < base or i == base and name.startswith("batch"):
                for what in ("values", "items"):
                    at, fs = self._path(f"{what}/{name}")
                    fs.delete(at, True)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = False):
        """Starts a query that adds each batch of a stream; `once` stops it when all that is there has been read."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
