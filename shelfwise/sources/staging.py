"""Named staged tables: written whole, replaced or dropped by name, all gone when their owner closes.

A :class:`Stage` owns one catalog database whose files lie in the session's
shared scratch folder, so every executor can read them and a lost one reads them
again. A table is written under a name of its own version first; only a finished
version is put under the table's name (a view that is replaced in one catalog
call), and then the version before it is dropped. A write that dies leaves the
name as it was. This is the original's ``IF OBJECT_ID(...) DROP TABLE`` and
``SELECT ... INTO #table``: the second run replaces the first, and nothing is
left once the session's owner is done.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfwise.session import scratch_root


class Stage:
    """Tables by name. Use it as a context manager, or call :meth:`close`."""

    def __init__(self, spark: SparkSession, scratch: str | None = None):
        self.spark = spark
        self.database = f"shelfwise_{uuid.uuid4().hex}"
        self.location = f"{scratch_root(spark, scratch)}/{self.database}"
        self._versions: dict[str, str] = {}
        self._lock = threading.Lock()
        self.closed = False
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.location}'")

    def replace(
        self,
        name: str,
        df: DataFrame,
        bucket_by: Sequence[str] = (),
        buckets: int = 0,
        sort_by: Sequence[str] = (),
        max_rows_per_file: int = 0,
    ) -> DataFrame:
        """Write ``df`` under ``name`` in place of what was there, and return the table.

        With ``buckets`` the files are bucketed by ``bucket_by`` (``df`` should be
        partitioned by the same columns, so that each bucket is one file) and
        sorted by ``sort_by``. A DataFrame over the version before cannot be
        read any more.
        """
        if self.closed:
            raise ValueError("the stage is closed")
        if not re.fullmatch(r"[A-Za-z]\w*", name):
            raise ValueError(f"not a table name: {name!r}")
        version = f"{self.database}.{name}__{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("maxRecordsPerFile", max_rows_per_file)
        if buckets:
            writer = writer.bucketBy(buckets, *bucket_by).sortBy(*sort_by)
        writer.saveAsTable(version)
        # Sizes of files only: the planner's broadcast decisions rest on them.
        self.spark.sql(f"ANALYZE TABLE {version} COMPUTE STATISTICS NOSCAN")
        with self._lock:
            before = self._versions.get(name)
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{name} AS SELECT * FROM {version}")
            self._versions[name] = version
            if before:
                self.spark.sql(f"DROP TABLE IF EXISTS {before}")
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        """The table's present version."""
        return self.spark.table(f"{self.database}.{name}")

    def __contains__(self, name: str) -> bool:
        return name in self._versions

    def names(self) -> list[str]:
        return sorted(self._versions)

    def drop(self, name: str) -> None:
        """Drop the table if it exists."""
        with self._lock:
            version = self._versions.pop(name, None)
            if version:
                self.spark.sql(f"DROP VIEW IF EXISTS {self.database}.{name}")
                self.spark.sql(f"DROP TABLE IF EXISTS {version}")

    def close(self) -> None:
        """Drop all tables and their folder."""
        if not self.closed:
            self.closed = True
            self._versions.clear()
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
