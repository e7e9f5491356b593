"""Operator 10: token ids as Parquet list columns.

The texts are range-partitioned by key, sorted, encoded (as operator 1 does, but in fragments of FRAGMENT characters and
more, which costs less than a table of words does) and written by Spark's Parquet writer in version 2
pages: the ids keep their dictionary (a vocabulary's ids fit one dictionary page, so each takes as many bits as the
vocabulary needs), the metadata columns are delta encoded. Row groups and pages are kept small and Parquet's column and
offset indexes are on, so a reader that wants a few documents, or only the metadata, reads only those pages.

Columns: doc_id, part (range number), local_start (ids of the part before the document), n_tokens (with the end id),
token_ids. `read_digests` reads them back: the starts from the metadata alone, and checksums from the ids.

Ties in the key are ordered by a hash of the text, then by the text, so that many texts of one key or of none make several
files; null keys come first; a null text has only the end id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .common import TOKENIZER

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, token_ids array<int>"
ROW_GROUP = 16 << 20
PAGE = 64 << 10
OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "1024",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def write_tokens(df: DataFrame, path: str, vocab: str = TOKENIZER, end_id: int | None = 2, partitions: int | None = None) -> None:
    """Encode ``df`` (doc_id, text) and write the files under ``path`` in ascending doc_id order."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        e, part, start = encoder(vocab), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            made = [e.encode(t, long=True) + end for t in b.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in made], np.int64)
            ends = np.cumsum(n)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(made), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), ids], names=["doc_id", "part", "local_start", "n_tokens", "token_ids"])
            start += int(ends[-1]) if len(ends) else 0

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    rows.mapInArrow(run, SCHEMA).write.options(**OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, ids: tuple[int, int] | None = None) -> DataFrame:
    """The files at ``path``: only ``columns``, only documents with ids[0] <= doc_id <= ids[1] (pages are skipped by index)."""
    df = spark.read.schema(SCHEMA).parquet(path)
    df = df if ids is None else df.where(F.col("doc_id").between(*ids))
    return df.select(*columns) if columns else df


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the checksum of its ids, from the files."""
    totals = read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            ids = b.column(4)
            at = np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(ids.values)).view(np.uint8))
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")  # a row a part
