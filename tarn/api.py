"""``Lake``: a catalog of versioned tables, read and written through one Spark session."""

from __future__ import annotations

import os
import shutil
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .operators.ddl import Ddl
from .operators.dml import Dml
from .operators.history import History
from .plans.scan import Scanner, quoted
from .sources.catalog import VERSION, Catalog, retrying
from .streaming.writer import StreamWriter


class Lake(Dml, Ddl, History):
    """``path`` is the catalog file, made if absent; data lies under ``data_path`` (any store that Spark reads; by default ``data/`` beside it).

    ``prefix`` names the catalog's tables. ``files_per_partition`` above 1 salts partitioned writes, where adaptive execution does not split large partitions.
    ``automatic_migration`` brings an older catalog to the current version.
    """

    def __init__(self, spark: SparkSession, path: str, data_path: str | None = None, prefix: str = "lake_", max_retries: int = 3, retry_wait_ms: float = 100, retry_backoff: float = 2.0, files_per_partition: int = 1, target_file_size: int = 512 << 20, automatic_migration: bool = False):
        self.spark, self.catalog = spark, Catalog(path, data_path, prefix)
        self.snapshot_column = f"_{prefix}internal_snapshot_id"
        self.retry = max_retries, retry_wait_ms, retry_backoff
        self._attempt = threading.local()
        self.files_per_partition, self.target_file_size = files_per_partition, target_file_size
        if automatic_migration and self.catalog.version != VERSION:
            self.migrate()
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")

    def retrying(self, run, max_retries: int | None = None, retry_wait_ms: float | None = None, retry_backoff: float | None = None):
        """Run again after conflicts. What an attempt has written and not committed is deleted, however it ends."""
        a, b, c = self.retry

        def attempt():
            outer, self._attempt.folders = getattr(self._attempt, "folders", None), []
            try:
                return run()
            finally:
                for path in self._attempt.folders:
                    if self.catalog.forget_write(path.rstrip("/").rsplit("/", 1)[-1]):
                        self.remove(path)
                self._attempt.folders = outer

        return retrying(a if max_retries is None else max_retries, b if retry_wait_ms is None else retry_wait_ms, c if retry_backoff is None else retry_backoff, attempt)

    def together(self, *runs) -> list:
        """The results of independent jobs, run at the same time as parts of this attempt."""
        folders = self._attempt.folders

        def part(run):
            self._attempt.folders = folders
            return run()

        with ThreadPoolExecutor(len(runs)) as pool:
            done = [pool.submit(part, r) for r in runs]
        return [d.result() for d in done]

    def new_folder(self, base: str, name: str) -> str:
        """A folder to write to; a vacuum spares it until it is committed, or its attempt has ended."""
        self.catalog.begin_write(name)
        self._attempt.folders.append(base + name)
        return base + name

    def table(self, name: str, schema: str = "main", version: int | None = None, timestamp=None, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """A lazy DataFrame, pinned to one snapshot. ``where`` also skips files by their statistics."""
        df = Scanner(self, self.at(name, schema, self.catalog.at(version, timestamp))).frame(where)
        return df.select(*map(quoted, columns)) if columns else df

    def files_scanned(self, name: str, where: str, schema: str = "main") -> tuple[int, int]:
        """(files that a scan with ``where`` reads, all files)."""
        sc = Scanner(self, self.at(name, schema))
        files = sc.data_files()
        return len(sc.prune(files, where)), len(files)

    def stream_writer(self, table: str, **options) -> StreamWriter:
        return StreamWriter(self, table, **options)

    def file_system(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def local_path(self, path: str) -> str | None:
        """The path on this machine's disk, if the store that it names (or the default one) is that disk."""
        fs, p = self.file_system(path)
        return p.toUri().getPath() if fs.getScheme() == "file" else None

    def remove(self, path: str) -> None:
        if (local := self.local_path(path)) is None:
            fs, p = self.file_system(path)
            fs.delete(p, True)
        elif os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif os.path.exists(local):
            os.remove(local)
