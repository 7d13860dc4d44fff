"""Toxicity by a factorization machine over hashed terms, trained in numpy.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), with x_i = 1 if the text holds term i. The pairwise part
learns what a sum of single weights can't: that two terms together weigh more, or less, than each alone. Terms are runs of
letters and digits, A-Z lower-cased, and their beginnings of some sizes (word stems), as 64-bit hashes; the model keeps the
TERMS terms that tell most by chi-square.

Training takes at most ``per_class`` labelled rows of each class (documented bound). Their terms are counted by a grouped
aggregate; at most TERMS of them, and of each row only which of these it holds, reach the driver. Scoring is one pass over whole texts without a shuffle; the model is at most TERMS * (FACTORS + 2) numbers.

Defined results: null counts as empty; a text without a known term gets the score of the bias; without training rows of
both classes every score is the share of the one class that there is, or 0. Repeated rows get equal scores; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIGNS, checkpointed, crc_mod, in_rows, keep_memory, pieces, text_bytes, word_hashes
from .labelled import sample

PER_CLASS, TERMS, FACTORS, LEAST_DF, EPOCHS, SEED = 3000, 4096, 8, 3, 12, 5
#: Sizes of word beginnings, in bytes.
STEMS = (3, 4, 5, 6)


def terms(text: pa.Array | pa.ChunkedArray):
    """Some texts at a time, about 1 MB: the first and the last row, hashes of all their terms, and offsets."""
    keep_memory()
    data, offsets = text_bytes(text)
    for first, last in pieces(offsets):
        yield first, last, *word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], SIGNS, STEMS)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


@dataclass
class FactorizationMachine:
    keys: np.ndarray  # sorted hashes of the terms
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def present(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of each row, once each: their numbers, and offsets."""
        n = len(offsets) - 1
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        pairs = np.unique(rows_of(offsets)[hit] * len(self.keys) + at[hit])
        row, term = np.divmod(pairs, len(self.keys))
        return term, np.searchsorted(row, np.arange(n + 1))

    def raw(self, term: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        v = self.factors[term].astype(np.float64)
        z = self.bias + in_rows(self.weight[term].astype(np.float64), offsets)
        for f in range(v.shape[1]):
            z += 0.5 * (in_rows(v[:, f], offsets) ** 2 - in_rows(v[:, f] ** 2, offsets))
        return z

    def score(self, text: pa.Array | pa.ChunkedArray) -> np.ndarray:
        z = np.zeros(len(text))
        for first, last, hashes, offsets in terms(text):
            z[first:last] = self.raw(*self.present(hashes, offsets))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    @classmethod
    def constant(cls, share: float) -> FactorizationMachine:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return cls(np.zeros(0, np.uint64), float(np.log(share / (1 - share))), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))


def telling(counted: list[tuple[int, int, int]], n: float, n1: float, n_terms: int = TERMS) -> np.ndarray:
    """Of (term, rows that hold it, toxic ones among these), the terms that tell most by chi-square, sorted."""
    keys = np.array([t for t, _, _ in counted], np.int64).view(np.uint64)
    df, pos = (np.array([c[k] for c in counted], float) for k in (1, 2))
    cover = df * n1 / n
    chi = (pos - cover) ** 2 / np.maximum(cover * (1 - n1 / n) * (1 - df / n), 1e-9)
    return np.sort(keys[np.lexsort((keys, -chi))[: min(n_terms, int((chi > 0).sum()))]])


def fit(keys: np.ndarray, docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3, batch: int = 64, seed: int = SEED) -> FactorizationMachine:
    """keys: the terms, sorted; docs: distinct ones of each row. Adagrad on the weighted logistic loss."""
    y = label.astype(np.float64)
    if not len(y) or y.min() == y.max() or not len(keys):
        return FactorizationMachine.constant(float(y.mean()) if len(y) else 0.0)
    n = len(y)
    best = np.arange(len(keys))
    found = [np.searchsorted(keys, d) for d in docs]
    col, row = np.concatenate(found), np.repeat(np.arange(n), [len(f) for f in found])
    offsets = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    bias, w, v = -0.7, np.zeros(len(best)), rng.normal(0, 0.01, (len(best), factors))
    sb, sw, sv = 1e-2, np.full(len(best), 1e-2), np.full(v.shape, 1e-2)
    # Toxic rows are few: together they count half as much as the others, so that a few terms can tell.
    weight = np.where(y > 0, weight / weight[y > 0].sum(), 2 * weight / weight[y == 0].sum())
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(n)
        for first in range(0, n, batch):
            rows = order[first : first + batch]
            x = np.zeros((len(rows), len(best)))
            for k, r in enumerate(rows):
                x[k, col[offsets[r] : offsets[r + 1]]] = 1
            xv = x @ v
            z = bias + x @ w + 0.5 * (xv**2 - x @ v**2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]) * weight[rows] / len(rows)
            used = np.flatnonzero(x.any(0))
            xu = x[:, used]
            gw = xu.T @ g + decay * w[used] / len(rows)
            gv = xu.T @ (g[:, None] * xv) - (xu.T @ g)[:, None] * v[used] + decay * v[used] / len(rows)
            gb = g.sum()
            sb += gb * gb
            sw[used] += gw * gw
            sv[used] += gv * gv
            bias -= rate * gb / np.sqrt(sb)
            w[used] -= rate * gw / np.sqrt(sw[used])
            v[used] -= rate * gv / np.sqrt(sv[used])
    return FactorizationMachine(keys, float(bias), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    rows, stands_for = sample(docs, labels, label_col, per_class, modulus, held, id_col, text_col)

    # Terms are counted where the rows are: the rows that hold each, of both classes, with partial sums on the map side. What
    # reaches the driver is the best of them by one chi-square's order, and of each row only those.
    rows = checkpointed(rows)

    def each(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, last, h, offsets in terms(batch.column(0)):
                row = rows_of(offsets)
                pairs = np.unique(np.stack([row.astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), pa.array(label[first:last][pairs[:, 0].astype(np.int64)], pa.int32())], ["term", "label"])

    sums = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    n, n1 = sum(sums.values()), sums.get(1, 0)
    if not n1 or n1 == n:
        return FactorizationMachine.constant(n1 / n if n else 0.0)
    counted = rows.select("text", "label").mapInArrow(each, "term long, label int").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("pos")).where(F.col("df") >= LEAST_DF)
    cover = F.col("df") * (n1 / n)
    chi = (F.col("pos") - cover) ** 2 / (cover * (1 - n1 / n) * F.greatest(1 - F.col("df") / n, F.lit(1e-9)))
    keys = telling([tuple(r) for r in counted.orderBy(chi.desc(), "term").limit(TERMS).collect()], n, n1)

    def run(batches):
        for batch in batches:
            out = [b""] * len(batch)
            for first, _, h, offsets in terms(batch.column(0)):
                for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
                    out[first + k] = np.intersect1d(h[a:b], keys).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary()), batch.column(2)], ["h", "terms", "label"])

    found = rows.select("text", F.xxhash64("id").alias("h"), "label").mapInArrow(run, "h long, terms binary, label int")
    got = sorted((r["h"], bytes(r["terms"]), r["label"]) for r in found.toLocalIterator())
    label = np.array([x[2] for x in got], np.int64)
    weight = np.array([stands_for[x] for x in label.tolist()])
    return fit(keys, [np.frombuffer(x[1], np.uint64) for x in got], label, weight)


def score(docs: DataFrame, model: FactorizationMachine, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            s = model.score(batch.column(1))
            out = [ids, pa.array(crc_mod(ids.to_pylist(), modulus) == held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
