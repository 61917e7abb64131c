"""Token ids in Parquet files that allow selective reads of tokens and of metadata.

A file holds one row per document, in ascending ``doc_id`` order over all files: the ids as a
list column with a dictionary (about two bytes an id), ``doc_id`` and the id counts with delta
encoding, row groups and pages of set sizes, and Parquet's page index. A reader that wants the
metadata never touches the ids, and a range of documents touches only its row groups and pages.
A small index table has one row per file: its first id's place among all ids, and its range.

Defined results: a missing text is empty and has the end id alone; rows without a ``doc_id``
come first; rows of one ``doc_id`` stand next to each other in the order of their texts; an
empty table gives files without rows; further columns are left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.scratch import Scratch
from .texts import map_texts
from .tokens import encoder, public_file

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
_ROWS = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()),
                   ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64()), ("file", pa.string())])


@dataclass(frozen=True)
class TokenFiles:
    """Folder of token files (``data``) with their index (``index``)."""

    spark: SparkSession
    path: str

    def rows(self, where: Column | None = None) -> DataFrame:
        """``doc_id``, ``n_tokens`` and ``ids`` of the wanted rows, with ``start``, the number of
        ids before the document; only the columns used are read."""
        data = self.spark.read.parquet(f"{self.path}/data").select(
            "*", F.col("_metadata.file_name").alias("file"))
        data = data if where is None else data.where(where)
        return self.with_start(data)

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def with_start(self, rows: DataFrame) -> DataFrame:
        """Replace the place inside the file by the place among all ids."""
        first = self.index().select("file", "first_start")
        return (rows.join(first, "file")
                .withColumn("start", F.col("first_start") + F.col("local_start"))
                .drop("file", "first_start", "local_start"))

    def digests(self) -> DataFrame:
        """One row per document, read back from the files: start, count and CRC-32 of its ids."""
        data = self.spark.read.parquet(f"{self.path}/data").select(
            "doc_id", "local_start", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
        rows = data.mapInArrow(_digest, from_arrow_schema(_DIGEST))
        return self.with_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                      files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES) -> TokenFiles:
    """Tokenise all documents and write them in ascending ``doc_id`` order.

    ``tokenizer`` is the path of a ``tokenizers`` file on the executors. The texts are dealt by
    ranges of ``doc_id`` and sorted inside them, so each file is one task's work.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select("doc_id", "text").repartitionByRange(n, "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    get, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

    def work():
        before = 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal before
            ids = [data + end for data in get().encode(batch.column("text").to_pylist())]
            counts = np.array([len(data) // 4 for data in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            places = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            values = np.frombuffer(b"".join(ids), "<i4")
            return {"doc_id": batch.column("doc_id"), "local_start": starts, "n_tokens": counts,
                    "ids": pa.ListArray.from_arrays(pa.array(places), pa.array(values))}

        return step

    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes,
               "parquet.page.size": page_bytes, "parquet.enable.dictionary": "true",
               **{f"parquet.enable.dictionary#{c}": "false"
                  for c in ("doc_id", "local_start", "n_tokens")}}
    # A task writes one file, whatever the session says, and places count within it.
    map_texts(ordered, work, _ROWS).write.options(**options).option("maxRecordsPerFile", 0).parquet(
        f"{path}/data")

    # Files are in the order of their task's number; as text 100000 would come before 10001.
    earlier = Window.orderBy(file_number("file")).rowsBetween(Window.unboundedPreceding, -1)
    (spark.read.parquet(f"{path}/data")
     .groupBy(F.col("_metadata.file_name").alias("file"))
     .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"),
          F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
     .withColumn("first_start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
     .write.parquet(f"{path}/index"))
    return TokenFiles(spark, path)


def file_number(name: str) -> Column:
    """Number of the task that wrote a file."""
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        places = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("local_start"), batch.column("n_tokens"),
             pa.array(sums, pa.int64()), batch.column("file")], schema=_DIGEST)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the tokens of all documents and read the files back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = Scratch(spark, "op9").path("tokens")
    return write_token_files(docs, path, public_file("word_bpe_49k.json"), end_id=2).digests()
