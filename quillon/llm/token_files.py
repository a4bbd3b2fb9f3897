"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The rank of an id by falling count over all texts is what is stored, so common ids take one byte. Four ranks share a control
byte (two bits each: bytes less one); the ranks' bytes stand in a stream of their own, which numpy decodes by a table from
control bytes to lengths.

Each text is encoded once. The first job deals texts by ranges of doc_id, encodes them in order and writes plain ids as a
table, a row per block, with the shard's counts in its last one; their sum, a column read alone, gives the ranks. The
second job maps ids to ranks block by block and writes the files.

A shard is a range of doc_id and has a folder ``shard=N``. A file is a run of blocks of one shard in ascending document order:

    magic "QVB2" | u32 shard | u32 block | u32 documents | u64 ids | u32 control bytes | u32 data bytes | u32 table entries
    table: u32 id of each rank (first block of a file only) | documents: i64 ids | u8 null flags | u32 lengths | control | data | "\n"

Blocks are written by Spark's text writer from binary values, so a task's files appear only once it has committed, on any
store that Spark writes, and a lost executor costs a rerun of its tasks. The number of shards follows the bytes of the texts;
the driver holds a table as long as the vocabulary and one total per shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_bpe import loaded, slices, with_end
from .shared import Work, map_batches, read_table, setting, shuffles_cleaned

END_ID = 0
#: Bytes of text of a shard, about, where there are more than the session's number of shuffle partitions.
SHARD_BYTES = 64_000_000
_HEAD, _MAGIC = "<4sIIIQIII", b"QVB2"
#: For each control byte the bytes, less one, of its four values.
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quads = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    return (quads << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    code = _CODES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(code, dtype=np.int64) + np.arange(n) - code
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(code >= k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded_blocks(df: DataFrame, tokenizer: str, end_id: int, shards: int) -> DataFrame:
    """(shard, block, docs, nulls, lengths, ids, counts): the ids of all texts in ascending order of doc_id, as raw bytes of
    little-endian numbers: 64, 8, 32, and 16 or 32 bits by the size of the vocabulary; 64 for counts by id, in a shard's last row."""

    def run(batches):
        from pyspark import TaskContext

        bpe, shard, block, held = loaded(tokenizer), TaskContext.get().partitionId(), 0, None
        size = max(bpe.size, end_id + 1)
        width, counts = "<u2" if size <= 1 << 16 else "<u4", np.zeros(size, "<i8")

        def row(raw, counts=b""):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in (*raw, counts))], names=names)

        for batch in slices(batches):
            if held:
                yield row(held)
                block += 1
            ids, n = with_end(*bpe.encode(batch.column(1)), end_id)
            keys = batch.column(0)
            docs, nulls = keys.fill_null(0).to_numpy().astype("<i8"), keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            counts += np.bincount(ids, minlength=size)
            held = [x.tobytes() for x in (docs, nulls, n.astype("<u4"), ids.astype(width))]
        if held:
            yield row(held, counts.tobytes())

    names = ["shard", "block", "docs", "nulls", "lengths", "ids", "counts"]
    # rows that tie on the id are dealt out too, however many they are
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.monotonically_increasing_id().alias("k2"))
    dealt = keyed.repartitionByRange(shards, "doc_id", "k1", "k2").sortWithinPartitions("doc_id", "k1", "k2")
    return map_batches(dealt.select("doc_id", "text"), "byte-bpe", run, "shard int, block int, docs binary, nulls binary, lengths binary, ids binary, counts binary")


def ranked_ids(blocks: DataFrame) -> np.ndarray:
    """The ids that occur in the blocks, by falling count, then by id; as many as the vocabulary has, at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                got = np.frombuffer(raw.as_buffer(), "<i8")
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = map_batches(blocks.select("counts"), "ranks", run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = {r.id: r.n for r in rows}
    return np.array(sorted(counts, key=lambda i: (-counts[i], i)), np.uint32)


def write_token_files(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every row's text, ``end_id`` after each, in ascending order of ``id_col``.

    A null text is empty. Rows with a null id come first; rows that tie keep no set order among them. Repeated rows are
    written each. An empty table gives no blocks. Other columns are ignored, whatever their names.
    """
    spark, work = df.sparkSession, Work(df.sparkSession, "token-blocks")
    df = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    encoded, encoded_path = work.table(encoded_blocks(df, tokenizer, end_id, shards), "encoded")
    ranked = ranked_ids(encoded)
    rank = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((ranked, rank))

    def run(batches):
        (ranked, rank), last = shared.value, None
        for batch in batches:
            for shard, block, docs, nulls, lengths, raw in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
                docs, nulls, lengths = (x.as_py() for x in (docs, nulls, lengths))
                total = int(np.frombuffer(lengths, "<u4").sum(dtype=np.int64))
                ids = np.frombuffer(raw.as_buffer(), "<u2" if len(raw.as_buffer()) == 2 * total else "<u4")
                control, data = vbyte_encode(rank[ids])
                table, last = b"" if shard == last else ranked.astype("<u4").tobytes(), shard
                head = struct.pack(_HEAD, _MAGIC, shard, block, len(nulls), len(ids), len(control), len(data), len(table) // 4)
                out = b"".join((head, table, docs, nulls, lengths, control, data))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([out], pa.binary())], names=["shard", "block"])

    # the writers of a task's shards stay open side by side, so blocks keep their order without a sort
    blocks = map_batches(encoded.select("shard", "block", "docs", "nulls", "lengths", "ids"), "ranks", run, "shard int, block binary")
    with shuffles_cleaned(spark), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(shards)):
        blocks.select("shard", F.col("block").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    work.drop(encoded_path)
    shared.unpersist()


def blocks_of(content: memoryview):
    """(shard, block, document ids with None for null, lengths, ids) of each block of a file; a ValueError where it is damaged."""
    at, table = 0, None
    while at < len(content):
        if at + struct.calcsize(_HEAD) > len(content):
            raise ValueError(f"damaged token file at byte {at}")
        magic, shard, block, docs, n, n_control, n_data, n_table = struct.unpack_from(_HEAD, content, at)
        parts, p = [], at + struct.calcsize(_HEAD)
        for size in (4 * n_table, 8 * docs, docs, 4 * docs, n_control, n_data):
            parts.append(content[p : p + size])
            p += size
        if magic != _MAGIC or p >= len(content) or content[p] != 10 or n_control != -(-n // 4):
            raise ValueError(f"damaged token file at byte {at}")
        if n_table:
            table = np.frombuffer(parts[0], "<u4")
        lengths = np.frombuffer(parts[3], "<u4").astype(np.int64)
        if lengths.sum() != n or table is None:
            raise ValueError(f"damaged token file at byte {at}")
        keys = pa.array(np.frombuffer(parts[1], "<i8"), mask=np.frombuffer(parts[2], np.uint8).astype(bool))
        yield shard, block, keys, lengths, table[vbyte_decode(parts[4], parts[5], n)]
        at = p + 1


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, start (ids before it over all files), n_tokens, ids_crc32, shard and, with
    ``with_ids``, its ids. Each file is read and decoded once; only one total per file is summed up in order."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                before, first = 0, None
                for shard, block, keys, n, ids in blocks_of(memoryview(content.as_buffer())):
                    first = block if first is None else first
                    flat, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(n)
                    crc = [zlib.crc32(flat[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    columns = [keys, pa.array(before + ends - n), pa.array(n), pa.array(crc, pa.int64()), *(pa.array(np.full(len(n), x, np.int32)) for x in (shard, first))]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    before += int(ends[-1])

    schema = "doc_id long, local long, n_tokens long, ids_crc32 long, shard int, first int" + ", ids array<int>" * with_ids
    names = [c.split(" ")[0] for c in schema.split(", ")]
    work = Work(spark, "token-rows")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path).select("content")
    rows, _ = work.table(map_batches(files, "token-files", run, schema), "rows")
    totals = rows.groupBy("shard", "first").agg(F.sum("n_tokens").alias("n")).collect()
    before, bases = 0, []
    for t in sorted(totals, key=lambda t: (t.shard, t.first)):
        bases.append((t.shard, t.first, before))
        before += t.n
    base = spark.createDataFrame(bases, "b_shard int, b_first int, base long")
    joined = rows.join(base, (F.col("shard") == F.col("b_shard")) & (F.col("first") == F.col("b_first")))
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", *["ids"] * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Work(spark, "token-files").path("files")
    write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path, with_ids=False)
