"""Language identification by a byte convolutional network, trained and applied in numpy.

The network: for each width, filters over the one-hot bytes of a fixed-length window (so a filter is a table of one
weight for each place and byte), rectified, max-pooled over the window, then a softmax layer. A document's windows cover
its whole text; their probabilities are averaged, weighted by their bytes.

Training takes up to ``per_language`` rows of each language, chosen by a hash of the id, and up to ``crops`` stretches of
each (documented bound: languages * per_language * crops * WINDOW bytes reach the driver). The weights (a few hundred
kB, whatever the input) travel with the task's code. Scoring is one pass without a shuffle.

Defined results: null texts, and texts without a letter, get `und` and score 0; without any training row every text gets
`und`. A text that has letters always gets a learned language. Repeated rows get equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, frugal, holdout, keep_memory, text_bytes
from .labelled import first_by_hash

WINDOW, WIDTHS, FILTERS = 512, (2, 3, 4), 16
PER_LANGUAGE, CROPS, EPOCHS, SEED = 1500, 2, 6, 11


class ByteCnn:
    def __init__(self, labels: list[str], filters: int = FILTERS, widths: tuple[int, ...] = WIDTHS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, self.widths = labels, widths
        self.filters = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        self.bias = [np.zeros(filters, np.float32) for _ in widths]
        self.out = rng.normal(0, 0.1, (filters * len(widths), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def pooled(self, windows: np.ndarray):
        """Max-pooled, rectified features of windows (n, length), and where each maximum stands."""
        length = windows.shape[1]
        flat = np.ascontiguousarray(windows.T).astype(np.intp)  # places first: the maximum then runs over whole rows
        feats, at = [], []
        for tables, bias in zip(self.filters, self.bias):
            w = len(tables)
            x = np.take(tables[0], flat[: length - w + 1], axis=0)
            for j in range(1, w):
                x += np.take(tables[j], flat[j : length - w + 1 + j], axis=0)
            top = x.argmax(0)
            at.append(top)
            feats.append(np.maximum(np.take_along_axis(x, top[None], 0)[0] + bias, 0))
        return np.concatenate(feats, 1), at

    def pair_tables(self) -> list[list[np.ndarray]]:
        """The filters as tables over pairs of bytes, then perhaps one over single bytes: fewer look-ups."""
        if not hasattr(self, "_pairs"):
            self._pairs = []
            for t in self.filters:
                both = [(t[j][None, :, :] + t[j + 1][:, None, :]).reshape(65536, -1) for j in range(0, len(t) - 1, 2)]
                self._pairs.append([*both, *([t[-1]] if len(t) % 2 else [])])
        return self._pairs

    def scored(self, windows: np.ndarray) -> np.ndarray:
        """pooled(), by pair tables."""
        length = windows.shape[1]
        single = np.ascontiguousarray(windows.T).astype(np.intp)  # places first: the maximum then runs over whole rows
        pair = single[:-1] | single[1:] << 8
        feats = []
        for tables, bias, w in zip(self.pair_tables(), self.bias, self.widths):
            size = length - w + 1
            x = np.take(tables[0], pair[:size], axis=0)
            for k, t in enumerate(tables[1:], 1):
                x += np.take(t, (pair if len(t) == 65536 else single)[2 * k : 2 * k + size], axis=0)
            feats.append(np.maximum(x.max(0) + bias, 0))
        return np.concatenate(feats, 1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.scored(windows) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 64, seed: int = SEED) -> ByteCnn:
        """Adagrad on the cross entropy; classes count alike."""
        keep_memory()
        rng = np.random.default_rng(seed)
        weight = 1.0 / np.maximum(np.bincount(target, minlength=len(self.labels)), 1)
        weight = (weight / weight[target].mean()).astype(np.float32)
        params = [*self.filters, *self.bias, self.out, self.out_bias]
        past = [np.full(p.shape, 1e-3, np.float32) for p in params]
        k = len(self.widths)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for first in range(0, len(order), batch):
                rows = order[first : first + batch]
                x, y = windows[rows], target[rows]
                feats, at = self.pooled(x)
                z = feats @ self.out + self.out_bias
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[np.arange(len(y)), y] -= 1
                g *= weight[y][:, None] / len(y)
                back = (g @ self.out.T) * (feats > 0)
                grads = [None] * len(params)
                f0 = 0
                for i, top in enumerate(at):
                    n_f = top.shape[1]
                    b = back[:, f0 : f0 + n_f]
                    f0 += n_f
                    grads[i] = np.zeros_like(self.filters[i])
                    for j in range(self.widths[i]):
                        seen = np.take_along_axis(x, top + j, 1)
                        np.add.at(grads[i][j], (seen, np.arange(n_f)[None, :]), b)
                    grads[k + i] = b.sum(0)
                grads[2 * k], grads[2 * k + 1] = feats.T @ g, g.sum(0)
                for p, s, d in zip(params, past, grads):
                    s += d * d
                    p -= rate * d / np.sqrt(s)
        return self


def windows_of(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW, at_once: int = 64):
    """Fixed-length windows that cover every text, some at a time: windows, the row of each, and its bytes of text."""
    sizes = np.diff(offsets)
    count = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * length
    real = np.minimum(offsets[1:][row] - start, length)
    step = np.arange(length)
    for k in range(0, len(row), at_once):
        s, r = start[k : k + at_once, None], real[k : k + at_once, None]
        yield np.where(step < r, data[np.minimum(s + step, len(data) - 1)], 0).astype(np.uint8), row[k : k + at_once], r[:, 0]


def predict(model: ByteCnn | None, text: pa.Array | pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    n = len(text)
    has_letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None or n == 0:
        return ["und"] * n, np.zeros(n)
    keep_memory()
    data, offsets = text_bytes(text)
    total = np.zeros((n, len(model.labels)))
    for windows, row, real in windows_of(data, offsets):
        np.add.at(total, row, model.probabilities(windows) * real[:, None])
    share = total / np.maximum(np.diff(offsets), 1)[:, None]
    best = share.argmax(1)
    score = np.where(has_letter, np.clip(share.max(1), 0, 1), 0.0)
    return [model.labels[b] if ok else "und" for b, ok in zip(best, has_letter)], score


def crop(data: bytes, doc_key: int, crops: int, length: int = WINDOW) -> list[bytes]:
    """Stretches of a text at places and of sizes that the key decides; short ones, too, as short texts occur."""
    rng = np.random.default_rng(doc_key & 0x7FFFFFFF)
    out = []
    for k in range(crops):
        size = length if k % 2 == 0 else int(rng.integers(6, length))
        start = int(rng.integers(0, max(1, len(data) - size + 1)))
        out.append(data[start : start + size])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, per_language: int = PER_LANGUAGE, crops: int = CROPS) -> ByteCnn | None:
    """A network from the labelled rows whose crc32(id) mod modulus is not held."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = rows.where((holdout("id", modulus) != held) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    chosen = first_by_hash(labelled.select("lang", F.col("id").alias("_id"), F.xxhash64("id").alias("h")), "lang", per_language)
    chosen = chosen.select(F.col("_id").alias("id")).distinct()

    def cut(batches):
        for batch in batches:
            parts = [crop(t.as_buffer().to_pybytes(), h, crops) for t, h in zip(batch.column(0).cast(pa.binary()), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(parts, pa.list_(pa.binary())), batch.column(2)], ["lang", "crops", "h"])

    rows = labelled.join(F.broadcast(chosen), "id", "left_semi").select("text", "lang", F.xxhash64("id").alias("h")).mapInArrow(frugal(cut), "lang string, crops array<binary>, h long")
    found = sorted((r["h"], r["lang"], [bytes(c) for c in r["crops"]]) for r in rows.toLocalIterator())
    if not found:
        return None
    labels = sorted({x[1] for x in found})
    windows = np.zeros((sum(len(x[2]) for x in found), WINDOW), np.uint8)
    target = np.zeros(len(windows), np.int64)
    k = 0
    for _, lang, parts in found:
        for part in parts:
            windows[k, : len(part)] = np.frombuffer(part, np.uint8)
            target[k] = labels.index(lang)
            k += 1
    return ByteCnn(labels).fit(windows, target)


def identify(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""

    def run(batches):
        for batch in batches:
            pred, score = predict(model, batch.column(1))
            ids = batch.column(0)
            out = pa.array(crc_mod(ids.to_pylist(), modulus) == held, pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, out, pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: ByteCnn | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language, as they are: those that get `und` go."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pred, _ = predict(model, batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array([p != "und" for p in pred], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
