"""A versioned table on any Hadoop file system, for ledgers that several drivers change at once.

A version is a marker file that names the Parquet folder of the rows it changed. The marker is published by an
operation that fails if another driver published that version first, so changes are made one after the other
without a lock; whoever loses reads again and repeats. Readers see one version, whatever is written meanwhile.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Rows by key; the latest version of a key wins. path may be any URI that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"

    def versions(self) -> dict[int, str]:
        """Folder of each version."""
        log = self._path(f"{self.path}/log")
        if not self._fs.exists(log):
            return {}
        out = {}
        for status in self._fs.listStatus(log):
            name = status.getPath().getName()
            if name.isdigit():
                stream = self._fs.open(status.getPath())
                try:
                    out[int(name)] = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the latest. Nothing that is committed later changes it."""
        rows, _ = self._snapshot(version)
        return rows

    def _snapshot(self, version: int | None = None) -> tuple[DataFrame, int]:
        found = {n: f for n, f in self.versions().items() if version is None or n <= version}
        if not found:
            raise ValueError(f"{self.path} has no version")
        parts = [self.spark.read.parquet(f"{self.path}/rows/{folder}").withColumn("_version", F.lit(n)) for n, folder in sorted(found.items())]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        columns = [c for c in rows.columns if c != "_version"]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_version").alias("r"))
        return last.select("r.*"), max(found)

    def commit(self, rows: DataFrame, base: int) -> bool:
        """Publish changed rows as version base + 1; False if that version is there already."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{folder}")
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        draft, marker = self._path(f"{self.path}/log/.{folder}"), self._path(f"{self.path}/log/{base + 1}")
        stream = self._fs.create(draft)
        stream.write(bytearray(folder.encode()))
        stream.close()
        if self._local:  # a local rename replaces a file, a link does not
            source = draft.toUri().getPath()
            try:
                os.link(source, marker.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                os.unlink(source)
            return True
        done = self._fs.rename(draft, marker)
        if not done:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(f"{self.path}/rows/{folder}"), True)
        return done

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 1000) -> int:
        """Commit the rows that change() makes of the latest version; repeats when another driver was first. Returns the version."""
        for _ in range(attempts):
            now, version = self._snapshot() if self.versions() else (None, 0)
            if self.commit(change(now), version):
                return version + 1
        raise RuntimeError(f"no version could be published in {attempts} attempts")

    def claim(self, worker: str, order: list, state: str = "status", attempts: int = 1000):
        """Take the first queued row for a worker: its state becomes claimed. Each row is given to one worker; None when none is left."""
        for _ in range(attempts):
            now, version = self._snapshot()
            first = now.where(F.col(state) == "queued").orderBy(*order).limit(1).collect()  # one row
            if not first:
                return None
            row = first[0].asDict() | {state: "claimed", "worker": worker}
            if self.commit(self.spark.createDataFrame([tuple(row[c] for c in now.columns)], now.schema).coalesce(1), version):
                return row[self.key]
        raise RuntimeError(f"no claim in {attempts} attempts")
