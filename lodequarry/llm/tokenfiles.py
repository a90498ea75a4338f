"""Token-id output: documents in id order, encoded and written as blocks of an adaptive range coder, and read back.

A file set is a Parquet folder of block rows, so that Spark commits it whole and any store that Spark reaches can hold it. A block
row has: file (number of the range partition), block (number in it), first (ids of the file before the block),
n_tokens, doc_ids, doc_sizes (ids of each document, the end id included) and payload (see rangecoder). Blocks are coded independently,
each with checksums of its bytes and of its ids, and never split a document.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequarry.llm import rangecoder, shared, tokens

BLOCK = 1 << 22


def _encoder(vocabulary: str, end: int, block: int, id_column: str):
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        file, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        docs: list = []
        sizes: list[np.ndarray] = []
        n = 0
        kind = None

        def row():
            ids = np.concatenate(held)
            size = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(kind)), pa.array([size], pa.list_(pa.int64())), pa.array([rangecoder.encode(ids)], pa.binary())],
                ["file", "block", "first", "n_tokens", "doc_ids", "doc_sizes", "payload"],
            )

        for whole in batches:
            kind = whole.schema.field(id_column).type
            for batch in shared.slices(whole, 2 << 20):
                ids, count = tokens.encoder(vocabulary).encode(batch.column(batch.schema.get_field_index("text")), end)
                of = batch.column(batch.schema.get_field_index(id_column)).to_pylist()
                edge = np.concatenate(([0], np.cumsum(count)))
                at = 0
                while at < len(of):  # as many documents as the block still takes, one at least
                    to = max(at + (n == 0), int(np.searchsorted(edge, edge[at] + block - n, "right")) - 1)
                    if to > at:
                        held.append(ids[edge[at] : edge[to]])
                        docs.extend(of[at:to])
                        sizes.append(count[at:to])
                        n += int(edge[to] - edge[at])
                        at = to
                    if at < len(of):
                        yield row()
                        number, first, held, docs, sizes, n = number + 1, first + n, [], [], [], 0
        if docs:
            yield row()

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 0, block: int = BLOCK, id_column: str = "doc_id") -> None:
    """Encode the text of every document (null: empty), append the end id, and write blocks in ascending order of the id column.

    Null ids come first; rows with one id stand side by side, ordered by their text. Files follow ranges of ids, so that no task
    holds more than its range, and a repeated task writes the same blocks. An empty table gives an empty folder of blocks.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"file int, block int, first long, n_tokens long, doc_ids array<{kind}>, doc_sizes array<long>, payload binary"
    ordered = docs.select(id_column, "text").repartitionByRange(F.col(id_column)).sortWithinPartitions(id_column, "text")
    blocks = ordered.mapInArrow(_encoder(vocabulary or tokens.default_vocabulary(), end, block, id_column), schema)
    with shared.small_batches(docs.sparkSession):
        blocks.write.parquet(path)


def _decoder(kind, with_ids: bool):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                ids = rangecoder.decode(get["payload"][k].as_py())
                docs, size = get["doc_ids"][k].values, np.array(get["doc_sizes"][k].values)
                begin = np.cumsum(size) - size
                if len(ids) != int(size.sum()):
                    raise rangecoder.CorruptBlock("a block's documents do not add up to its ids")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), size.tolist())]
                start = begin + get["base"][k].as_py() + get["first"][k].as_py()
                out = [docs, pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[a : a + n].astype(np.int64) for a, n in zip(begin.tolist(), size.tolist())], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set: a row per document with start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids.

    Raises CorruptBlock if a checksum fails. Only the number of ids of each file is summed up in one place (a row per file).
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.join(F.broadcast(files), "file").mapInArrow(_decoder(kind, with_ids), schema)
