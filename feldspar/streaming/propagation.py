"""Evidence changes as a stream that keeps flags, and effective-dated versions that arrive in any order."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.flags import FlagStore
from .jobs import ingest_stream


def propagate_flags(changes: DataFrame, documents: DataFrame, store: FlagStore, checkpoint: str) -> None:
    """Runs what is new of a stream of evidence changes through ``FlagStore.apply``, a folder of flags a micro-batch."""
    ingest_stream(changes, lambda batch, number: store.apply(documents, batch, number), checkpoint)


INTERVALS = "key string, version bigint, effective_from date, effective_to date, revision bigint"


class VersionIntervals(StatefulProcessor):
    """Per key a map of (effective_from, version); an arrival splits the interval it falls into.

    Out come the new version's interval and that of the version before it, each with a revision that grows per key: the
    row with the highest revision of a (key, version) is the one that holds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getMapState("starts", "version bigint", "effective_from date")
        self.revision = handle.getValueState("revision", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = {v[0]: d[0] for v, d in self.starts.iterator()} if self.starts.exists() else {}
        n = self.revision.get()[0] if self.revision.exists() else 0
        before = intervals(known)
        fresh = set()
        for row in rows:
            if row.version is not None and row.effective_from is not None and row.effective_from > known.get(row.version, datetime.date.min):
                known[row.version] = row.effective_from
                fresh.add(row.version)
        for version in fresh:
            self.starts.updateValue((version,), (known[version],))
        for version, (start, stop) in sorted(intervals(known).items()):
            if before.get(version) != (start, stop):
                n += 1
                yield Row(key=key[0], version=version, effective_from=start, effective_to=stop, revision=n)
        self.revision.update((n,))

    def close(self) -> None:
        pass


def intervals(starts: dict[int, datetime.date]) -> dict[int, tuple[datetime.date, datetime.date | None]]:
    """Each version holds from its date to that of the next; of two with one date the lower one holds for no day."""
    order = sorted(starts.items(), key=lambda x: (x[1], x[0]))
    return {v: (d, order[i + 1][1] if i + 1 < len(order) else None) for i, (v, d) in enumerate(order)}


def version_intervals(arrivals: DataFrame) -> DataFrame:
    """A stream (key, version, effective_from) as a stream of changed intervals, in any order of arrival.

    Of several dates of one version the latest holds, so the order of arrival doesn't matter. Rows without a version or a
    date are left out. A key's state is its versions. Needs the RocksDB state store.
    """
    return arrivals.groupBy("key").transformWithState(VersionIntervals(), INTERVALS, "Update", "None")


def held_intervals(changes: DataFrame) -> DataFrame:
    """The intervals that hold, of all changes that ``version_intervals`` gave."""
    last = F.max_by(F.struct("effective_from", "effective_to"), F.col("revision")).alias("s")
    return changes.groupBy("key", "version").agg(last).select("key", "version", "s.*")


def batch_intervals(versions: DataFrame) -> DataFrame:
    """The same intervals from a bounded table (key, version, effective_from)."""
    own = Window.partitionBy("key").orderBy("effective_from", "version")
    rows = versions.where("version is not null and effective_from is not null").groupBy("key", "version").agg(F.max("effective_from").alias("effective_from"))
    return rows.select("key", "version", "effective_from", F.lead("effective_from").over(own).alias("effective_to"))
