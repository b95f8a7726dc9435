"""Tables of days whose corrections come late.

A table is a folder of data and one of manifests. A manifest names, for each day, the folders that hold its rows; the
greatest number is the table as it is. A batch rewrites the days that it touches and no others, into new folders, and
then writes the next manifest by one rename of a finished file, which fails if another writer was faster. So readers see all of
a batch or nothing, what a batch reads grows with its days, not with the table, and a batch that is run again is known by its name and skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.upsert import keep_last


class Conflict(Exception):
    """Another writer has written this version of the table."""


class VersionedTable:
    """Rows with keys and a day (a date column), the last by version of each key and day."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], day: str = "day", version: Sequence[str] = ()) -> None:
        self.spark, self.path, self.keys, self.day, self.version = spark, path, list(keys), day, list(version)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        at = self._hadoop.Path(path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """The numbers of all manifests, in order."""
        at = self._at("manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, number: int | None = None) -> dict:
        """{number, schema, days: {day: [folders]}, batches: {run: last batch}}; an empty one of a new table."""
        known = self.versions()
        if number is None and not known:
            return {"number": 0, "schema": None, "days": {}, "batches": {}}
        if number is not None and number not in known:
            raise ValueError(f"no version {number} of {self.path}")
        file = self._fs.open(self._at("manifests", f"{known[-1] if number is None else number}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def read(self, number: int | None = None, days: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, of the given days alone if any are named; other days' files aren't opened."""
        m = self.manifest(number)
        if m["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        folders = sorted({f for day, own in m["days"].items() if days is None or day in days for f in own})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _commit(self, before: dict, schema: StructType, days: dict[str, list[str]], run: str | None, batch: int | None) -> int:
        after = {"number": before["number"] + 1, "schema": schema.json(), "days": days, "batches": before["batches"] | ({run: batch} if run is not None else {})}
        draft, to = self._at("manifests", f"_{uuid.uuid4().hex}"), self._at("manifests", f"{after['number']}.json")
        self._fs.mkdirs(self._at("manifests"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise Conflict(f"{self.path} has a version {after['number']} already")
        return after["number"]

    def _write(self, rows: DataFrame, before: dict, touched: set[str], run: str | None, batch: int | None) -> int:
        """The next version: `rows` in place of the days `touched`."""
        into = uuid.uuid4().hex
        # a day's rows come together as far as a partition holds them; a large day is split
        rows.withColumn("_of", F.col(self.day)).hint("rebalance", self.day).write.partitionBy("_of").parquet(f"{self.path}/data/{into}")
        written = {s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(self._at("data", into)) if "=" in s.getPath().getName()}
        days = {d: f for d, f in before["days"].items() if d not in touched}
        days |= {d: [f"{into}/_of={d}"] for d in written}
        return self._commit(before, rows.schema, days, run, batch)

    def _days_of(self, rows: DataFrame) -> set[str]:
        """The days of a batch: as many as the calendar has, not as rows."""
        return {str(r[0]) for r in rows.select(F.col(self.day).cast("date")).distinct().collect()}

    def merge(self, batch: DataFrame, run: str | None = None, number: int | None = None) -> int:
        """Fold a batch in; the table's version afterwards.

        Of rows of one key and day the last by version stays, those of the batch where versions are equal. Rows without
        a day are left out. `run` and `number` name a batch: one not greater than the last of its run is skipped.
        """
        before = self.manifest()
        if run is not None and before["batches"].get(run, -1) >= number:
            return before["number"]
        batch = batch.where(F.col(self.day).isNotNull()).withColumn(self.day, F.col(self.day).cast("date"))
        touched = self._days_of(batch)
        if not touched:
            return before["number"]
        both = batch.withColumn("_new", F.lit(1))
        if set(before["days"]) & touched:
            both = both.unionByName(self.read(before["number"], sorted(touched)).withColumn("_new", F.lit(0)), allowMissingColumns=True)
        last = keep_last(both, [*self.keys, self.day], [*self.version, "_new"]).drop("_new")
        return self._write(last, before, touched, run, number)

    def refresh(self, source: DataFrame, back: int = 2) -> int:
        """Take the days from `back` days before the last stored one on from source, and put them in place of those stored:
        what source no longer has goes. An empty table takes all."""
        before = self.manifest()
        source = source.where(F.col(self.day).isNotNull()).withColumn(self.day, F.col(self.day).cast("date"))
        if before["days"]:
            start = F.date_sub(F.lit(max(before["days"])).cast("date"), back)
            source = source.where(F.col(self.day) >= start)
            first = self.spark.range(1).select(start.cast("string")).first()[0]
        last = keep_last(source, [*self.keys, self.day], self.version or self.keys)
        touched = {d for d in before["days"] if d >= first} if before["days"] else set()
        return self._write(last, before, touched, None, None)

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the last `keep` versions, with the data that none of those left has; the number of folders removed."""
        known = self.versions()
        kept = {f for n in known[-keep:] for own in self.manifest(n)["days"].values() for f in own}
        for n in known[:-keep]:
            self._fs.delete(self._at("manifests", f"{n}.json"), False)
        gone = 0
        for run in self._fs.listStatus(self._at("data")):
            for day in self._fs.listStatus(run.getPath()):
                if "=" in day.getPath().getName() and f"{run.getPath().getName()}/{day.getPath().getName()}" not in kept:
                    self._fs.delete(day.getPath(), True)
                    gone += 1
        return gone

    def merge_stream(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Fold each micro-batch of a stream in, once; stops when input is used up."""

        def fold(batch: DataFrame, number: int) -> None:
            run = self.spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
            self.merge(batch, run, number)

        return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
