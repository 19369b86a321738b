"""Token ids in ORC files (operator 7).

One file per range of document ids, ascending; within a file, rows ascend too.
Integers are run-length encoded by the format; row indexes and a Bloom filter
on the document id let readers skip stripes and row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrowtext, bpe

#: Writer settings: stripes that one task reads at once, row groups for the indexes, Bloom filters.
OPTIONS = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}

#: Bytes of text for a file, at most on average; the session's shuffle partitions are the least number of files.
FILE_BYTES = 256 << 20


def write(df: DataFrame, vocabulary: str, path: str, end: int = 0, text: str = "text", key: str = "doc_id", files: int | None = None) -> None:
    """Encodes every text, appends `end`, and writes (part, first, doc_id, ids) in ascending order of the key.

    part: the number of the file's range.  first: ids before the row in its
    range.  Null texts hold only the end id; null keys come first; rows with
    equal keys are ordered by a hash of their text.
    """
    bpe.checked(vocabulary)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = files or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, coder = TaskContext.get().partitionId(), 0, bpe.codec(vocabulary)
        for batch in batches:
            for piece in arrowtext.pieces(batch, text):
                ids, rows = coder.encode(piece.column(1))
                ids = np.insert(ids, rows[1:], end)
                rows = rows + np.arange(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(piece), part, np.int32)), pa.array(before + rows[:-1]), piece.column(0), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))],
                    ["part", "first", "doc_id", "ids"],
                )
                before += int(rows[-1])

    order = [F.col("k").asc_nulls_first(), F.col("h")]
    ranged = df.select(F.col(key).alias("k"), F.col(text).alias(text), F.xxhash64(text).alias("h")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.select("k", text).mapInArrow(run, f"part int, first bigint, doc_id {kind}, ids array<int>").write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files: part, first, doc_id, ids."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents; the filter reaches the file metadata, so other stripes aren't read."""
    return read(spark, path).where(F.col("doc_id").isin(keys)).select("doc_id", "ids")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the files, from what is read back.

    start: ids of all rows before it over all files.  The driver sees one
    total per file.
    """
    stored = read(spark, path)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = memoryview(column.flatten().to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            ends = np.cumsum(lengths) * 4
            crc = [zlib.crc32(raw[a:z]) for a, z in zip((ends - 4 * lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths), pa.array(crc, pa.int64())], ["part", "first", "doc_id", "n_tokens", "ids_crc32"])

    digests = stored.select("part", "first", "doc_id", "ids").mapInArrow(run, f"part int, first bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")
    totals = stored.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n")).orderBy("part").toPandas()
    before = pd.DataFrame({"part": totals["part"].astype("int32"), "before": (totals["n"].cumsum() - totals["n"]).astype("int64")})
    before = spark.createDataFrame(before, "part int, before bigint")
    return digests.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
