"""What several text operators share: checkpoints, Arrow text buffers, vectorised hashing and block keys.

Blocks. Operators that must look something up for every word or position of the corpus deal the documents into
*blocks* by a hash of the id, send each block's distinct 64-bit hashes to *buckets* (ranges of the hash), and get the
answer for each hash back. A block or bucket is one row group of bounded size: their numbers grow with the input, so
no task holds more as the corpus grows.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text in a block, and entries of a bucket, that are aimed at.
BLOCK_BYTES, BUCKET_ENTRIES = 8_000_000, 1_500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this machine's, and only if driver and executors
    are this one process: on a cluster nobody else could read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp("-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def let_go(spark: SparkSession, most: float = 3.0) -> None:
    """Shuffle files and checkpoints of steps that nothing refers to any more are removed now, not when the driver happens to
    collect its garbage. Python tells the JVM of objects it has dropped in the background; this waits for it, not for ever."""
    gc.collect()
    told, end = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None), time.time() + most
    while told and time.time() < end:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holdout(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id's text, modulo modulus."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_mod(ids, modulus: int) -> np.ndarray:
    """The same as holdout() for a sequence of ids."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids), np.int64, len(ids))


def keep_memory() -> None:
    """Lets this process keep up to 64 MB of freed memory for its next arrays, instead of giving it back and faulting it in again."""
    if not _powers.get("kept"):
        _powers["kept"] = True
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        except (OSError, AttributeError):
            pass  # another C library: only slower


def give_back() -> None:
    """What this process has freed goes back to the system: a worker that waits for its next task holds only what it still uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: only larger


def frugal(function):
    """function, for mapInArrow or applyInArrow, with give_back() when its batches or its group are done. Workers outlive their
    tasks, and an executor counts them all."""
    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def run(batches):
            try:
                yield from function(batches)
            finally:
                give_back()

        return run
    # Spark tells functions of groups apart by their arguments.
    if len(inspect.signature(function).parameters) == 1:

        def run_group(table: pa.Table) -> pa.Table:
            try:
                return function(table)
            finally:
                give_back()

        return run_group

    def run_both(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            give_back()

    return run_both


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, with n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 1_000_000):
    """Ranges (first, last) of rows whose bytes are at most `most`, or one row if that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def sorted_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned keys of at most `bits` bits in order, and their places, equal keys by place. Where both have room in 64 bits, a
    place is sorted along in the low bits of its key: faster than sorting places by key."""
    low = max(1, len(keys).bit_length())
    if bits + low <= 64:
        packed = np.sort(keys << U64(low) | np.arange(len(keys), dtype=np.uint64))
        return packed >> U64(low), (packed & U64((1 << low) - 1)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with inverse and counts, for unsigned keys of at most `bits` bits."""
    ordered, order = sorted_places(keys, bits)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return ordered[start], inverse, np.diff(np.append(start, len(keys)))


BYTE_KEYS = mix(np.arange(256, dtype=np.uint64) * U64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: All ASCII characters but letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, both modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Rolling:
    """Polynomial hashes, modulo 2**64 over keyed bytes, of any stretches of one byte array: O(1) each."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and n + 1 offsets of rows in words.
    Words end at the end of their row. gaps: other bytes that part words. stems: for each of these sizes in bytes, each
    word is followed by the hash of its beginning of that size (of a shorter word, its own hash again)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    head = ~gap
    head[1:] &= gap[:-1]
    tail = ~gap
    tail[:-1] &= gap[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    head[edge] |= ~gap[edge]
    tail[edge - 1] |= ~gap[edge - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    rolling, rows = Rolling(LOWER[data]), np.searchsorted(start, offsets).astype(np.int64)
    h = rolling.of(start, end)
    if stems:
        cut = [np.where(end - start > k, rolling.of(start, np.minimum(start + k, end)) + U64(k), h) for k in stems]
        h, rows = np.stack([h, *cut], 1).ravel(), rows * (1 + len(stems))
    return h, rows


def words_of_rows(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() in pieces of bounded size."""
    hashes, counts = [], []
    for first, last in pieces(offsets):
        h, o = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], gaps, stems)
        hashes.append(h)
        counts.append(np.diff(o))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def in_rows(values: np.ndarray, offsets: np.ndarray, reduce=np.add) -> np.ndarray:
    """Sums of values over the rows that offsets delimit; empty rows get 0."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = reduce.reduceat(values, offsets[:-1][full])
    return out


def with_records(rows: DataFrame, groups: DataFrame, keys: list[str], heavy: F.Column) -> DataFrame:
    """rows with their group's columns, by null-safe keys. Heavy groups, whose number has a bound, are broadcast."""
    named = [f"_{k}" for k in keys]

    def on(left: DataFrame, right: DataFrame):
        return [left[k].eqNullSafe(right[n]) for k, n in zip(keys, named)]

    for k, n in zip(keys, named):
        groups = groups.withColumnRenamed(k, n)
    hot, rest = F.broadcast(groups.where(heavy)), groups.where(~heavy)
    near = rows.join(hot, on(rows, hot)).drop(*named)
    light = rows.join(hot, on(rows, hot), "left_anti")
    return near.unionByName(light.join(rest, on(light, rest)).drop(*named))


def text_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes: two numbers."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def bits_for(entries: float, least: int = 4) -> int:
    """Bits of a hash to deal `entries` by, so that a bucket holds about BUCKET_ENTRIES, whatever their number."""
    return min(30, max(least, int(np.ceil(np.log2(max(1.0, entries / BUCKET_ENTRIES))))))


def width_for(bits: int) -> int:
    """Bits that are sent of a key besides `bits`, so that at least 60 of its 64 decide."""
    return 56 if bits <= 8 else 48 if bits <= 16 else 40 if bits <= 24 else 32


def block_count(n_bytes: int) -> int:
    return max(8, -(-n_bytes // BLOCK_BYTES))


def block_of(id_col: str, n_bytes: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(block_count(n_bytes))).cast("int")


def blocks(docs: DataFrame, id_col: str, text_col: str, n_bytes: int) -> DataFrame:
    """(blk, id, text) for every row; about BLOCK_BYTES of text share a blk."""
    return docs.select(block_of(id_col, n_bytes).alias("blk"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def squeeze(raw: bytes) -> bytes:
    """raw, compressed; empty for nothing."""
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""


def expand(raw) -> bytes:
    raw = memoryview(raw)
    return pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True) if len(raw) else b""


def written_by_block(rows: DataFrame, n_bytes: int, make=None, schema: str | None = None) -> DataFrame:
    """rows (with a column blk) written once in partitions of whole blocks; make, if given, is applied to each block before. Steps
    that group by blk read them where they lie, without another shuffle. Only a plan that isn't adaptive says how what it wrote
    is partitioned."""
    conf = rows.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Fewer partitions than a shuffle has would be dealt out again.
        # What a function makes of a block has no known partitioning either, so its rows are dealt out once more.
        n = max(int(conf.get("spark.sql.shuffle.partitions")), -(-block_count(n_bytes) // 2))
        written = checkpointed((rows.groupBy("blk").applyInArrow(make, schema) if make else rows).repartition(n, "blk"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
    let_go(written.sparkSession)
    return written


def dealt_texts(docs: DataFrame, id_col: str, text_col: str, n_bytes: int) -> DataFrame:
    """blocks(), with texts squeezed, written by block."""

    def run(batches):
        for batch in batches:
            text = [squeeze(t.as_buffer().to_pybytes()) if t.is_valid else b"" for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary())], ["blk", "id", "text"])

    rows = blocks(docs, id_col, text_col, n_bytes).mapInArrow(run, f"blk int, id {docs.schema[id_col].dataType.simpleString()}, text binary")
    return written_by_block(rows, n_bytes)


def unpacked(text: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts of dealt_texts()."""
    return pa.array([expand(t.as_buffer()) for t in text], pa.binary())
