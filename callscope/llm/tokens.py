"""Token ids of a corpus in binary shards, in document order.

A shard holds consecutive documents. Its ids are replaced by their frequency
ranks in the shard (the table is in the shard), so that common ids are small, and
the ranks are stored in as many whole bytes as they need: one control byte says
the lengths of four ranks, two bits each, and stands apart from the data bytes.
A reader turns control bytes to byte masks by one table lookup and decodes the
whole shard at once.

Layout, little-endian: magic ``CSB1``; int64 numbers of documents, ids, ranks and
data bytes; per document int64 id, uint8 "id is null", int64 number of ids; the
rank table as uint32; the control bytes; the data bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import bounded, materialise, new_path, table, text_or_empty
from callscope.llm.wordpieces import encoder

END_ID = 0
SHARD_IDS = 1 << 20
#: Distinct words, and pieces of new words, that a worker holds encoded: its process stays near 500 MB.
HELD_WORDS, HELD_PIECES = 500_000, 250_000
MAGIC = b"CSB1"
#: For each control byte the byte mask of its four ranks.
MASKS = (np.arange(4) <= ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)[:, :, None]).reshape(256, 16)


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's bytes."""
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    seen = seen[np.argsort(-counts[seen], kind="stable")]
    rank_of = np.zeros(len(counts), "<u4")
    rank_of[seen] = np.arange(len(seen), dtype="<u4")
    ranks = rank_of[ids]
    sizes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = sizes
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= sizes[:, None]]
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ids), len(seen), len(data)], "<i8")
    given = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), given.tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), seen.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack(shard: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """A shard's document ids, numbers of ids and ids."""
    if shard[:4] != MAGIC:
        raise ValueError("not a token shard")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(shard, kind, n, at)
        at += out.nbytes
        return out

    docs, n, seen, data = take("<i8", 4)
    given, null, lengths, ids_of = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<u4", seen)
    control = take("u1", -(-int(n) // 4))
    ranks = np.zeros((len(control) * 4, 4), np.uint8)
    mask = MASKS[control].reshape(-1, 4)
    mask[n:] = False
    ranks[mask] = take("u1", data)
    ids = ids_of[ranks.view("<u4").reshape(-1)[:n]] if n else np.zeros(0, "<u4")
    return [None if x else int(d) for d, x in zip(given, null)], lengths, ids


def _store(path: str, shard: bytes) -> None:
    """Write a file that no other attempt writes; the manifest names the one that counts."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_output_stream(place) as out:
        out.write(shard)


def _writer(folder: str, tokenizer_path: str, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(tokenizer_path, HELD_WORDS, HELD_PIECES)
        end = np.array([END_ID], "<u4").tobytes()
        made, docs, lengths, held, size = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, docs, lengths, held, size
            name = f"part-{part:06d}-{made:06d}-{uuid.uuid4().hex}.bin"
            _store(f"{folder}/{name}", pack(docs, np.array(lengths, "<i8"), np.frombuffer(b"".join(held), "<u4")))
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "place": [made], "n_ids": [size]}, schema=_MANIFEST)
            made, docs, lengths, held, size = made + 1, [], [], [], 0
            return row

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = words.encode(text.as_py()) + end
                docs.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return write


_MANIFEST = pa.schema([("name", pa.string()), ("part", pa.int64()), ("place", pa.int64()), ("n_ids", pa.int64())])


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents' ids to ``folder`` in ascending doc_id order, null ids last.

    Returns the manifest (name, part, place, n_ids, base), base being the number of
    ids before the shard; a file that it does not name is left of a lost attempt and
    is not read. Texts are dealt out by ranges of (doc_id, text hash), so
    rows of one id are in a stated order and may be in several shards. Null texts
    are empty: they have the end id alone. An empty table writes no shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = materialise(sorted_rows.transform(bounded).mapInArrow(_writer(folder, tokenizer_path, shard_ids), "name string, part long, place long, n_ids long"), "manifest")
    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("ids").over(line), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(by_part, "part").withColumn("base", F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("before")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch["name"].to_pylist(), batch["content"]):
            doc_ids, lengths, ids = unpack(content.as_py())
            ends = np.cumsum(lengths)
            starts = ends - lengths
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["name", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """Decode the shards and give each document's place, length and CRC-32."""
    spark = manifest.sparkSession
    manifest = manifest.select("name", "base")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    found = files.transform(bounded).mapInArrow(_digests, "name string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(manifest, "name").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: write every document's ids and read the shards back."""
    folder = new_path(spark, "token-shards")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_digests(folder, materialise(manifest, "placed-manifest"))
