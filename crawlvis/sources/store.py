"""Rows by key, kept as versions in tables that Spark deals into buckets.

A store is a table bucketed by its key and sorted by it in each bucket, with Bloom filters of the key in its files: what
looks for a key reads one bucket, and in it only files and row groups that may have it. An update is a
further version; the newest counts. Joins with a store and the newest rows of all keys need no shuffle of it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlvis.sources.shared import new_path

#: Buckets of a store, about one for each 256 MB that it will hold; a choice that holds for as long as it lives.
BUCKETS = 32


@dataclass(frozen=True)
class Store:
    """``name`` in the catalog; rows have the columns ``key`` and ``at``, their version."""

    spark: SparkSession
    name: str
    key: str = "scan_id"
    at: str = "version"
    buckets: int = BUCKETS

    @classmethod
    def made(cls, rows: DataFrame, label: str, **kept) -> Store:
        """A store of its own for ``rows``, with its files in the shared folder."""
        store = cls(rows.sparkSession, f"{label}_{uuid.uuid4().hex}", **kept)
        store._write(rows, new_path(rows.sparkSession, label))
        return store

    def _write(self, rows: DataFrame, path: str | None) -> None:
        # Dealt as the table is, so that a write makes one file of each bucket.
        out = rows.repartition(self.buckets, self.key).write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key, self.at)
        out = out.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        (out.option("path", path) if path else out).saveAsTable(self.name)

    def append(self, rows: DataFrame) -> None:
        """Inserts, and updates of rows that are there. Null keys are kept and never found."""
        self._write(rows.select(*self.versions().columns), None)

    def versions(self) -> DataFrame:
        return self.spark.table(self.name)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), self.at).alias("_row")).select(self.key, "_row.*")

    def newest(self) -> DataFrame:
        """The newest version of every row. Buckets hold whole keys, so nothing is shuffled."""
        return self._newest(self.versions().where(F.col(self.key).isNotNull()))

    def row(self, *keys) -> DataFrame:
        """The newest versions of some keys' rows, from their buckets alone; no row where there is none."""
        return self._newest(self.versions().where(F.col(self.key).isin(*keys)))

    def rows_of(self, asked: DataFrame) -> DataFrame:
        """``asked`` with the newest row of its key; without those whose key isn't there. Only ``asked`` is shuffled."""
        return asked.join(self.newest(), self.key)

    def compacted(self, label: str) -> Store:
        """A new store that holds the newest version of each row alone; the old one stays until it is dropped."""
        return Store.made(self.newest(), label, key=self.key, at=self.at, buckets=self.buckets)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def last_done(scans: Store, *urls: str) -> DataFrame:
    """The done scan of each URL that finished last: scan_id, normalized_url, score, finished_at. scans: a store by normalized_url."""
    rows = scans.versions().where(F.col(scans.key).isin(*urls) & (F.col("status") == "done") & F.col("finished_at").isNotNull())
    return rows.groupBy(scans.key).agg(F.max_by(F.struct("scan_id", "score", "finished_at"), F.struct("finished_at", "scan_id")).alias("_row")).select(scans.key, "_row.*")
