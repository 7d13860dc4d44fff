"""Counting and looking up 64-bit keys of the whole corpus, with packed messages.

A block sends each of its distinct keys once, as sorted arrays: the leading bits name the bucket, the next 32 are sent.
A bucket counts its keys over all blocks and answers each message with one byte a key, in its order. The block computes
its keys anew and lays the answers beside them. So a key costs a few bytes of shuffle, and a hot key one entry a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, frugal, keep_memory, sorted_places

MESSAGE = "bucket int, blk int, rest binary, times binary"
REPLY = "blk int, bucket int, code binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("rest", pa.binary()), ("times", pa.binary())])
_REPLY = pa.schema([("blk", pa.int32()), ("bucket", pa.int32()), ("code", pa.binary())])


def short(keys: np.ndarray, bits: int, width: int = 32) -> np.ndarray:
    """The leading bits + width bits of keys."""
    return keys >> U64(64 - width - bits)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of sorted keys, plane by plane: the leading planes hardly change, and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, width // 8 - 1 :: -1].T).tobytes()


def from_planes(raw, width: int) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8).reshape(width // 8, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, width // 8 - 1 :: -1] = got.T
    return out.view("<u8")[:, 0]


def messages(blk: int, keys: np.ndarray, times: np.ndarray, width: int = 32) -> pa.Table:
    """keys: sorted, distinct, from short(); times: how often each occurs in the block."""
    bucket = (keys >> U64(width)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    often = np.minimum(times, 255).astype(np.uint8)
    n = len(cut) - 1
    return pa.table([pa.array(bucket[cut[:-1]] if n else [], pa.int32()), pa.array([blk] * n, pa.int32()), pa.array([planes(keys[a:b], width) for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([often[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=_MESSAGE)


def coded(total: np.ndarray) -> np.ndarray:
    """0 for keys that occur once; else a byte that grows with the count."""
    big = 128 + np.minimum(127, np.floor(8 * np.log2(np.maximum(total, 128) / 128.0)))
    return np.where(total < 2, 0, np.where(total < 128, total, big)).astype(np.uint8)


def count_bucket(table: pa.Table, width: int = 32) -> pa.Table:
    """All messages of one bucket: counts over blocks, and a reply to each."""
    keep_memory()
    blk, bucket = table.column("blk"), table.column("bucket")
    rest = [from_planes(x.as_buffer(), width) for x in table.column("rest")]
    keys = np.concatenate(rest)
    times = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("times")])
    ordered, order = sorted_places(keys, width)
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.flatnonzero(head)
    code = coded(np.add.reduceat(times[order].astype(np.int64), start))
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(code, np.diff(np.concatenate([start, [len(keys)]])))
    cut = np.cumsum([0, *map(len, rest)])
    return pa.table([blk.cast(pa.int32()), bucket.cast(pa.int32()), pa.array([out[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=_REPLY)


def count(sent: DataFrame, width: int = 32) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(frugal(lambda table: count_bucket(table, width)), REPLY)


def answers(replies: pa.Table) -> np.ndarray:
    """The codes of a block's keys, in the keys' order."""
    got = sorted(zip(replies.column("bucket").to_pylist(), replies.column("code")), key=lambda x: x[0])
    return np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for _, c in got]) if got else np.zeros(0, np.uint8)
