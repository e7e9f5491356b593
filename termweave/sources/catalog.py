"""Shards of a dataset: names that hold a time range and a version, and the choice of shards for a time range.

A dataset is a folder of shards, ``<root>/<dataset>/<shard>[.<version>]``, each a folder of Parquet files. Folders are listed
through Hadoop's file systems, so the root may be anywhere that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

#: The zone of the times in shard names, and the two patterns of names.
ZONE = timezone(timedelta(hours=-6))
VERSIONED = re.compile(r"(.+)\.([0-9]{14})")
TIMED = re.compile(r"index([0-9]{8})(?:\.([0-9]{2}))?(?:-([0-9]{8})\.([0-9]{2}))?")


def _time(day: str, hour: str | None) -> datetime:
    return datetime.strptime(day, "%Y%m%d").replace(tzinfo=ZONE) + timedelta(hours=int(hour or 0))


@dataclass(frozen=True, order=True)
class Shard:
    shard_id: str
    version: int = 0

    @staticmethod
    def parse(name: str) -> Shard:
        m = VERSIONED.fullmatch(name)
        return Shard(m[1], int(m[2])) if m else Shard(name)

    @property
    def folder(self) -> str:
        return f"{self.shard_id}.{self.version:014d}" if self.version else self.shard_id

    @property
    def times(self) -> tuple[datetime, datetime] | None:
        """[start, end): a day, an hour, or from one hour to another; None if the name holds no time."""
        m = TIMED.fullmatch(self.shard_id)
        if not m or m[3] and not m[2]:
            return None
        try:
            start = _time(m[1], m[2])
            return start, _time(m[3], m[4]) if m[3] else start + (timedelta(hours=1) if m[2] else timedelta(days=1))
        except ValueError:
            return None


def newest(shards: Iterable[Shard]) -> list[Shard]:
    """Of each shard the highest version."""
    best: dict[str, Shard] = {}
    for s in shards:
        if s.shard_id not in best or s.version > best[s.shard_id].version:
            best[s.shard_id] = s
    return sorted(best.values())


def overlapping(start: datetime, end: datetime) -> Callable[[Shard], bool]:
    """A filter: shards with a time in [start, end)."""
    return lambda s: s.times is not None and s.times[1] > start and s.times[0] < end


def without_overlaps(shards: Iterable[Shard], start: datetime) -> list[Shard]:
    """Shards that follow each other in time: by start, not before ``start``, then the newest; what overlaps a chosen one goes."""
    timed = [s for s in shards if s.times]
    chosen, upto = [], None
    for s in sorted(timed, key=lambda s: (max(s.times[0], start), -s.version)):
        if upto is None or max(s.times[0], start) >= upto:
            chosen.append(s)
            upto = s.times[1]
    return chosen


def gaps(chosen: Sequence[Shard], start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """Stretches of [start, end) that no chosen shard holds; shards in the order of their times."""
    out, upto = [], start
    for s in chosen:
        if upto < s.times[0]:
            out.append((upto, s.times[0]))
        upto = s.times[1]
    return [*out, (upto, end)] if upto < end else out


def subfolders(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


class Catalog:
    """Datasets below a root. Listed when asked, so that new shards and versions are seen."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def datasets(self) -> list[str]:
        return subfolders(self.spark, self.root)

    def shards(self, dataset: str, keep: Callable[[Shard], bool] = lambda s: True) -> list[Shard]:
        return newest(s for s in map(Shard.parse, subfolders(self.spark, f"{self.root}/{dataset}")) if keep(s))

    def path(self, dataset: str, shard: Shard) -> str:
        return f"{self.root}/{dataset}/{shard.folder}"

    def describe(self) -> DataFrame:
        """(dataset, shard, version, start, end, columns): what there is, and each shard's fields from its files' footers."""
        rows = []
        for d in self.datasets():
            for s in self.shards(d):
                t = s.times
                columns = self.spark.read.parquet(self.path(d, s)).columns
                rows.append((d, s.shard_id, s.version, t and t[0].astimezone(timezone.utc).isoformat(), t and t[1].astimezone(timezone.utc).isoformat(), columns))
        return self.spark.createDataFrame(rows, "dataset string, shard string, version long, start string, end string, columns array<string>")

    def status(self) -> DataFrame:
        """(dataset, shards, files, bytes): what the newest versions of a dataset's shards take."""
        rows = []
        for d in self.datasets():
            shards = self.shards(d)
            sizes = [self._size(self.path(d, s)) for s in shards]
            rows.append((d, len(shards), sum(n for n, _ in sizes), sum(b for _, b in sizes)))
        return self.spark.createDataFrame(rows, "dataset string, shards int, files long, bytes long")

    def _size(self, path: str) -> tuple[int, int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        got = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p)
        return got.getFileCount(), got.getLength()

    def fields(self, dataset: str) -> list[str]:
        """All columns of the dataset's shards, whose schemas may differ."""
        return sorted({c for s in self.shards(dataset) for c in self.spark.read.parquet(self.path(dataset, s)).columns})

    def choose(self, dataset: str, start: datetime, end: datetime) -> list[Shard]:
        return without_overlaps(self.shards(dataset, overlapping(start, end)), start)


@dataclass(frozen=True)
class SessionBuilder:
    """A session on the shards of a time range, or on named ones."""

    catalog: Catalog
    dataset: str
    start: datetime | None = None
    end: datetime | None = None
    named: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.named is None and (self.start is None or self.end is None):
            raise ValueError("a time range or the names of shards are needed")
        if self.start is not None and self.end is not None and self.end <= self.start:
            raise ValueError("a time range must end after it starts")

    def shards(self) -> list[Shard]:
        if self.named is not None:
            return [Shard.parse(n) for n in self.named]
        return self.catalog.choose(self.dataset, self.start, self.end)

    def missing(self) -> list[tuple[datetime, datetime]]:
        return gaps(self.shards(), self.start, self.end)

    def read(self) -> DataFrame:
        from .dataset import read_shards

        return read_shards(self.catalog.spark, [self.catalog.path(self.dataset, s) for s in self.shards()])

    def open(self, ints: Iterable[str] | None = None, strings: Iterable[str] | None = None):
        from ..operators.session import Session

        return Session.open(self.read(), ints, strings)

    def each(self, most_docs: int, use: Callable) -> list:
        """``use`` of a session for each batch of shards of at most ``most_docs`` documents (one shard at least)."""
        from ..operators.session import Session
        from .dataset import read_shards

        spark, batch, held, out = self.catalog.spark, [], 0, []
        paths = [self.catalog.path(self.dataset, s) for s in self.shards()]
        for p in paths:
            n = spark.read.parquet(p).count()  # from the footers
            if batch and held + n > most_docs:
                out.append(use(Session.open(read_shards(spark, batch))))
                batch, held = [], 0
            batch.append(p)
            held += n
        if batch:
            out.append(use(Session.open(read_shards(spark, batch))))
        return out
