"""A keyed table with commits: batches replace whole keys, readers see one snapshot, writers commit optimistically.

A folder holds `data/<id>` (rows of a batch), `keys/<id>` (the keys that the batch settles) and `log/<version>.json` (the
batches of that version, oldest first). Nothing is ever changed in place: a batch is written under a new id, then named by
a new version of the log. A batch that no version names does not exist, so a writer that dies leaves nothing to repair but
files that `vacuum` removes. The newest batch that settles a key owns all of its rows; one that settles a key without
rows deletes it. Rows lie by bucket of their key, so the number of files grows with the data and not with the keys.

The log is a file of a few dozen entries, since batches are merged in a geometric family: a row is rewritten a
logarithmic number of times. The keys of batches never come to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 512
_MADE_BY = "__batch"


class Conflict(RuntimeError):
    """Another writer has changed what a commit was derived from."""


class Snapshot:
    """One version of the table: its batches, oldest first."""

    def __init__(self, table: KeyedTable, version: int, batches: list[dict]) -> None:
        self.table, self.version, self.batches = table, version, batches

    def rows(self, only: DataFrame | None = None) -> DataFrame | None:
        """The rows of this version; with `only`, those of its keys. None before the first row.

        Batches that were overruled for a key lose their rows of it. The oldest batch, which holds most rows, is held
        against the keys of younger ones only.
        """
        held = [b for b in self.batches if b["rows"]]
        if not held:
            return None
        key = self.table.key
        rows = self._scan("data", held)
        if only is not None:
            rows = rows.join(only.select(F.col(key), self.table.bucket(F.col(key)).alias("__bucket")).distinct(), ["__bucket", key], "left_semi")
        younger = self.batches[1:]
        if younger:
            newest = self._scan("keys", younger).groupBy("__bucket", key).agg(F.max(self._place()).alias("__owner"))
            rows = rows.withColumn("__place", self._place()).join(newest, ["__bucket", key], "left")
            rows = rows.where("__owner is null or __owner = __place").drop("__owner", "__place")
        return rows.drop("__bucket", _MADE_BY)

    def keys(self) -> DataFrame | None:
        """The keys that have rows."""
        rows = self.rows()
        return None if rows is None else rows.select(self.table.key).distinct()

    def _scan(self, part: str, batches: list[dict]) -> DataFrame:
        spark = self.table.spark
        return spark.read.option("mergeSchema", True).parquet(*(f"{self.table.folder}/{part}/{b['id']}" for b in batches))

    def _place(self) -> Column:
        """The place of the batch that made a row."""
        known = F.create_map(*(F.lit(x) for i, b in enumerate(self.batches) for x in (b["id"], i)))
        return F.try_element_at(known, F.col(_MADE_BY))


class KeyedTable:
    """A table in `folder` whose rows are replaced by `key`. Null keys are refused: they would never be replaced.

    Commits rely on a rename that fails where the target is, as HDFS and stores behind Hadoop's FileContext give it; on a
    local disk that is a test and a rename, enough for one machine's tests.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an earlier one that is still kept."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot(self, 0, [])
        stream = self._files.open(self._path(f"log/{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self, version, json.loads(text)["batches"])

    def versions(self) -> list[int]:
        found = self._files.globStatus(self._path("log/*.json")) or []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found)

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Put `rows` in place of what their keys held, and delete the keys of `gone`: the version that shows it.

        The batch depends on no other one, so a lost race is only a later number. The same batch again changes nothing.
        """
        batch = self._write(rows, gone)
        return self._commit(lambda now: [*now.batches, batch])

    def rewrite(self, made: Callable[[Snapshot], tuple[DataFrame, DataFrame | None] | None], tries: int = 5) -> int:
        """Commit what `made` derives from a snapshot (rows, keys to delete; None: nothing), again from a newer one where
        another writer was first."""
        for _ in range(tries):
            base = self.snapshot()
            found = made(base)
            if found is None:
                return base.version
            batch = self._write(*found)
            try:
                return self._commit(lambda now, base=base, batch=batch: [*now.batches, batch] if self._same(base, now) else None)
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: {tries} writers were first")

    def compact(self, factor: int = 2, whole: bool = False) -> int:
        """Merge the youngest batches, as many as have together no fewer than 1 / `factor` of the rows of the next older
        one; `whole`: all. Batches that are committed meanwhile stay above the merged one."""
        base = self.snapshot()
        start, total = len(base.batches), 0
        for i in range(len(base.batches) - 1, -1, -1):
            size = base.batches[i]["rows"] + base.batches[i]["keys"]
            if i < len(base.batches) - 1 and not whole and total * factor < size:
                break
            start, total = i, total + size
        merged = base.batches[start:]
        if len(merged) < 2:
            return base.version
        part = Snapshot(self, base.version, merged)
        rows, settled = part.rows(), part._scan("keys", merged).select(self.key).distinct()
        # below the oldest batch there is nothing that a deleted key has to hide
        batch = self._write(part._scan("data", merged).drop("__bucket", _MADE_BY).limit(0) if rows is None else rows, settled if start else None)

        def put(now: Snapshot) -> list[dict] | None:
            known = now.batches[: len(base.batches)]
            return [*base.batches[:start], batch, *now.batches[len(base.batches) :]] if known == base.batches else None

        try:
            return self._commit(put)
        except Conflict:  # another writer has merged: nothing is lost
            return self.snapshot().version

    def vacuum(self, keep: int = 1, older_ms: int = 7 * 24 * 3600 * 1000) -> int:
        """Delete all but the newest `keep` versions, and batches that no version left names and that are older than any
        running writer or reader (`older_ms`): how many folders went."""
        versions, now = self.versions(), self._jvm.java.lang.System.currentTimeMillis()
        for v in versions[: max(0, len(versions) - max(1, keep))]:
            self._files.delete(self._path(f"log/{v:012d}.json"), False)
        named = {b["id"] for v in self.versions() for b in self.snapshot(v).batches}
        n = 0
        for part in ("data", "keys"):
            for f in self._files.globStatus(self._path(f"{part}/*")) or []:
                if f.getPath().getName() not in named and now - f.getModificationTime() >= older_ms:
                    n += bool(self._files.delete(f.getPath(), True))
        return n

    def _same(self, base: Snapshot, now: Snapshot) -> bool:
        """Whether a newer snapshot holds the same rows: nothing was added, though batches may have been merged."""
        return now.version == base.version

    def _write(self, rows: DataFrame, gone: DataFrame | None) -> dict:
        """A batch under a new id, with the keys that it settles. A key that holds most rows is dealt to several tasks."""
        own = uuid.uuid4().hex
        marked = rows.drop("__bucket", _MADE_BY).withColumns({"__bucket": self.bucket(F.col(self.key)), _MADE_BY: F.lit(own)})
        checked = marked.withColumn(self.key, F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit(f"{self.key} is null")).cast(rows.schema[self.key].dataType)))
        data = f"{self.folder}/data/{own}"
        checked.hint("rebalance", F.col("__bucket")).sortWithinPartitions("__bucket", self.key).write.parquet(data)
        written = self.spark.read.schema(checked.schema).parquet(data)
        settled = written.select(self.key, "__bucket")
        if gone is not None:
            settled = settled.unionByName(gone.select(self.key).where(F.col(self.key).isNotNull()).withColumn("__bucket", self.bucket(F.col(self.key))))
        keys = f"{self.folder}/keys/{own}"
        settled.distinct().withColumn(_MADE_BY, F.lit(own)).write.parquet(keys)
        return {"id": own, "rows": written.count(), "keys": self.spark.read.parquet(keys).count()}

    def _commit(self, made: Callable[[Snapshot], list[dict] | None]) -> int:
        while True:
            now = self.snapshot()
            batches = made(now)
            if batches is None:
                raise Conflict(self.folder)
            if self._put(now.version + 1, json.dumps({"batches": batches})):
                return now.version + 1

    def _put(self, version: int, text: str) -> bool:
        """Write a version of the log, unless another writer has: a whole file, or none."""
        temporary, final = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{version:012d}.json")
        stream = self._files.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except (Py4JJavaError, PySparkException):
            if not self._files.exists(final):
                raise
            self._files.delete(temporary, False)
            return False

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
