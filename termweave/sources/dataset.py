"""Documents in and out: Parquet shards, documents and term lists from memory, merges, copies and derived fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: documents that a writer holds before it writes a segment.
BUFFERED_DOCS = 500


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All shards' documents with their ``_shard`` folder; a field that a shard lacks is missing in its documents."""
    if not paths:
        raise ValueError("no shard")
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.withColumn("_shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def open_index(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """An index of any format that Spark reads, told by its files' names unless ``kind`` says it."""
    if kind is None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        kinds = {k for f in files for k in ("parquet", "orc", "json", "csv") if not f.startswith(("_", ".")) and f".{k}" in f}
        if len(kinds) != 1:
            raise ValueError(f"can't tell the format of {path}: {sorted(kinds) or 'no known files'}")
        kind = kinds.pop()
    reader = spark.read.format(kind)
    return (reader.option("header", "true").option("inferSchema", "true") if kind == "csv" else reader).load(path)


def numbered(df: DataFrame) -> DataFrame:
    """With ``_doc``, a number for each document that stays the same while the files do."""
    return df.withColumn("_doc", F.monotonically_increasing_id())


def write_shard(df: DataFrame, path: str, sort_by: Sequence[str] = (), mode: str = "errorifexists", codec: str = "zstd") -> None:
    """One shard. Sorted within its files by ``sort_by``, so that conditions on these columns skip pages."""
    hidden = [c for c in df.columns if c.startswith("_")]
    df = df.drop(*hidden)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode(mode).option("compression", codec).parquet(path)


def _column(values: Iterable, wide: bool) -> T.DataType:
    kind = T.LongType() if all(isinstance(v, (int, bool)) for v in values) else T.StringType()
    return T.ArrayType(kind) if wide else kind


def from_documents(spark: SparkSession, documents: Sequence[Mapping], start: int = 0) -> DataFrame:
    """Documents as mappings from a field to its terms (or a single one); all-integer fields are integer fields."""
    names = list(dict.fromkeys(n for d in documents for n in d))
    listed = lambda v: [] if v is None else list(dict.fromkeys(v)) if isinstance(v, (list, tuple, set)) else [v]
    terms = {n: [t for d in documents for t in listed(d.get(n))] for n in names}
    schema = T.StructType([T.StructField("_doc", T.LongType()), *(T.StructField(n, _column(terms[n], True)) for n in names)])
    cast = {n: int if isinstance(schema[n].dataType.elementType, T.LongType) else str for n in names}
    return spark.createDataFrame([(start + i, *([cast[n](t) for t in listed(d.get(n))] for n in names)) for i, d in enumerate(documents)], schema)


def from_terms(spark: SparkSession, n_docs: int, fields: Mapping[str, Mapping]) -> DataFrame:
    """An index as mappings from a field to its terms and from a term to the documents that have it."""
    docs: list[dict] = [{f: [] for f in fields} for _ in range(n_docs)]
    for f, terms in fields.items():
        for t, ids in terms.items():
            for i in ids:
                docs[i][f].append(t)
    return from_documents(spark, docs)


class DocumentWriter:
    """Writes documents one by one: segments of BUFFERED_DOCS first, one compacted shard in the end."""

    def __init__(self, spark: SparkSession, path: str, buffer: int = BUFFERED_DOCS, files: int = 1):
        self.spark, self.path, self.buffer, self.files = spark, path.rstrip("/"), buffer, files
        self.held: list[Mapping] = []
        self.segments = 0

    def __enter__(self) -> DocumentWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()

    def add(self, document: Mapping) -> None:
        self.held.append(document)
        if len(self.held) >= self.buffer:
            self.flush()

    def flush(self) -> None:
        if self.held:
            from_documents(self.spark, self.held).drop("_doc").coalesce(1).write.mode("overwrite").parquet(f"{self.path}.segments/{self.segments:08d}")
            self.held, self.segments = [], self.segments + 1

    def close(self) -> None:
        self.flush()
        if self.segments:
            parts = [self.spark.read.parquet(f"{self.path}.segments/{i:08d}") for i in range(self.segments)]
            merge(parts).coalesce(self.files).write.mode("overwrite").parquet(self.path)
            delete(self.spark, f"{self.path}.segments")


def merge(indexes: Sequence[DataFrame]) -> DataFrame:
    """All documents of several indexes; a field that is a string field in one of them is one in the result."""
    kinds: dict[str, set] = {}
    for df in indexes:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())

    def same(df: DataFrame) -> DataFrame:
        for f in df.schema.fields:
            if len(kinds[f.name]) > 1:
                wide = any(k.startswith("array") for k in kinds[f.name])
                text = any("string" in k for k in kinds[f.name])
                c = F.col(f"`{f.name}`")
                if wide and not isinstance(f.dataType, T.ArrayType):
                    c = F.filter(F.array(c), lambda t: t.isNotNull())
                one = "string" if text else "bigint"
                df = df.withColumn(f.name, c.cast(f"array<{one}>" if wide else one))
        return df

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(same, indexes))


def add_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With a computed field; longs and arrays of longs make an integer field, strings a string field."""
    if name in df.columns:
        raise ValueError(f"there is a field {name}")
    return df.withColumn(name, value)


def sort_index(df: DataFrame, *order: str | Column) -> DataFrame:
    """Documents in a new order, with new numbers."""
    return df.drop("_doc").orderBy(*order).withColumn("_doc", F.monotonically_increasing_id())


def delete(spark: SparkSession, path: str) -> bool:
    """Remove an index's files. Whether there were any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def copy_index(spark: SparkSession, source: str, target: str, columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    df = spark.read.parquet(source)
    write_shard(df.select(*columns) if columns else df, target, mode=mode)


def copy_shards(catalog, dataset: str, target_root: str, keep: Callable = lambda s: True) -> list[str]:
    """Copies of the shards that ``keep`` wants, below another root, under the same names."""
    done = []
    for s in catalog.shards(dataset, keep):
        copy_index(catalog.spark, catalog.path(dataset, s), f"{target_root.rstrip('/')}/{dataset}/{s.folder}", mode="overwrite")
        done.append(s.folder)
    return done


def copy_time_range(catalog, dataset: str, target_root: str, start: datetime, end: datetime) -> list[str]:
    """Copies of the shards that start in [start, end)."""
    return copy_shards(catalog, dataset, target_root, lambda s: s.times is not None and start <= s.times[0] < end)


def write_term_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Term statistics in ascending order of field, term and group."""
    stats.orderBy("field", F.desc("is_int"), "int_term", "str_term", "grp").write.mode(mode).option("compression", "zstd").parquet(path)


def read_term_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_term_stats(parts: Sequence[DataFrame]) -> DataFrame:
    """Statistics of disjoint sets of documents, summed by field, term and group."""
    keys = ["field", "is_int", "int_term", "str_term", "grp"]
    values = [c for c in parts[0].columns if c not in keys]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, modified, md5) of each file of an index, to tell whether a copy is whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))
