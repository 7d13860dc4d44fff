"""Quality by hierarchical empirical Bayes: a document's own evidence, its site's record and its section's record.

1. Evidence: a logistic regression on style features of the whole text (shares of capitals, digits, signs and letters,
   word sizes, repeats), trained in numpy on at most ``per_class`` labelled rows of each class (documented bound).
2. Records: outcomes (the label where a training row has one, the evidence elsewhere) are summed by (host, path), then by
   host, then over all, by grouped aggregation with map-side partial sums; a hot host is a few numbers a task. Prior
   strengths come from the data by moments: kappa = share within groups over variance between them.
3. Posteriors: a document never counts in its own record. Of the other documents, the global mean is the prior of the
   host's mean, and that one of the path's: with n others of sum s, (s + kappa * prior) / (n + kappa). A sparse site stays near
   the global mean.
4. A document's log-odds are those of its evidence plus those of its path's posterior against the global prior.

Heavy groups (those with over 1 / ``small`` of all rows, so fewer than ``small``) are joined by broadcast, and their rows
never shuffled; the others by a shuffled join.

Defined results: null text counts as empty; null hosts and paths are groups of their own; without training rows of both
classes the evidence is the share of the one class, or 0.5; a site of one document adds nothing; repeated rows are documents of
their own and get equal results; a null id has no label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIGNS, SPACE, checkpointed, crc_mod, in_rows, keep_memory, pieces, text_bytes, with_records, word_hashes
from .labelled import labels_of, sample

PER_CLASS, SMALL, MODULUS, HELD = 6000, 100_000, 5, 0
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SIGN = SIGNS & ~SPACE


def features(text: pa.Array | pa.ChunkedArray) -> np.ndarray:
    keep_memory()
    data, offsets = text_bytes(text)
    out = np.zeros((len(offsets) - 1, 9))
    for first, last in pieces(offsets, 1_000_000):
        d, o = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        size = np.maximum(np.diff(o), 1).astype(float)
        of = lambda table: in_rows(table[d].astype(np.int32), o) / size  # noqa: B023, E731
        h, w = word_hashes(d, o)
        row = np.repeat(np.arange(len(o) - 1), np.diff(w))
        n_words = np.maximum(np.diff(w), 1).astype(float)
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        repeats = np.bincount(row[order][1:][same], minlength=len(o) - 1) if len(h) > 1 else np.zeros(len(o) - 1)
        next_same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        runs = np.bincount(row[1:][next_same], minlength=len(o) - 1) if len(h) > 1 else np.zeros(len(o) - 1)
        x = [of(_UPPER), of(_DIGIT), of(_SIGN), of(SPACE), np.log1p(size) / 10, np.log1p(size / n_words), repeats / n_words, runs / n_words]
        out[first:last, :8] = np.stack(x, 1)
        out[first:last, 8] = 1
    return out


class Logistic:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        self.mean, self.scale, self.weight = mean, scale, weight

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        """Features, their roots and products."""
        base = np.concatenate([x[:, :-1], np.sqrt(np.abs(x[:, :4]))], 1)
        i, j = np.triu_indices(base.shape[1])
        return np.concatenate([x[:, -1:], base, base[:, i] * base[:, j]], 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        z = cls.expand(x)
        mean, scale = z.mean(0), z.std(0) + 1e-6
        mean[0], scale[0] = 0, 1
        z = (z - mean) / scale
        b = np.zeros(z.shape[1])
        penalty = np.full(len(b), ridge)
        penalty[0] = 1e-6
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (w * (p - y)) + penalty * b
            step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty), g)
            b -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, b)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.expand(x) - self.mean) / self.scale @ self.weight, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, modulus: int = MODULUS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> Logistic | float:
    rows, stands_for = sample(docs, labels, label_col, per_class, modulus, held, id_col, text_col)

    def run(batches):
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(2)], ["h", "x", "label"])

    got = sorted((r["h"], tuple(r["x"]), r["label"]) for r in rows.select("text", F.xxhash64("id").alias("h"), "label").mapInArrow(run, "h long, x array<double>, label int").toLocalIterator())
    y = np.array([g[2] for g in got], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return Logistic.fit(np.array([g[1] for g in got]), y, np.array([stands_for[int(v)] for v in y]))


def evidence(docs: DataFrame, model: Logistic | float, host: F.Column, path: F.Column, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            p = model.predict(features(batch.column(3))) if isinstance(model, Logistic) else np.full(len(ids), model)
            out = pa.array(crc_mod(ids.to_pylist(), modulus) == held, pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, out, batch.column(1), batch.column(2), pa.array(np.clip(p, 1e-6, 1 - 1e-6), pa.float64())], ["doc_id", "held_out", "host", "path", "evidence"])

    rows = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, host string, path string, evidence double")


def strength(groups: DataFrame, total: str, n: str) -> float:
    """kappa of a level, by moments: what a group's own record must weigh against. One row reaches the driver."""
    mean = f"({total} / {n})"
    r = groups.crossJoin(F.broadcast(groups.agg((F.sum(total) / F.sum(n)).alias("m")))).agg(
        F.sum(F.expr(f"{n} * ({mean} - m) * ({mean} - m)")).alias("ss"), F.sum(F.expr(f"{mean} * (1 - {mean})")).alias("noise"), F.sum(n).alias("n"), F.max("m").alias("m")
    ).first()
    if not r["n"]:
        return 1.0
    within = max(r["m"] * (1 - r["m"]), 1e-9)
    between = max((r["ss"] - r["noise"]) / r["n"], within / 1e4)
    return min(max(within / between - 1, 1.0), 1e4)


def quality(docs: DataFrame, model: Logistic | float, host: F.Column, path: F.Column, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, threshold: float = 0.5, labels: DataFrame | None = None, label_col: str = "quality", modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """Per row: doc_id, held_out, evidence, host_mean, path_mean, score, keep; the means are posteriors without the row itself."""
    rows = evidence(docs, model, host, path, id_col, text_col, modulus, held)
    outcome = F.col("evidence")
    if labels is not None:
        known = labels_of(labels, label_col).select("_id", "label")
        rows = rows.join(known, (F.col("doc_id") == F.col("_id")) & ~F.col("held_out"), "left")
        outcome = F.coalesce(F.col("label").cast("double"), outcome)
    rows = checkpointed(rows.select("doc_id", "held_out", "host", "path", "evidence", outcome.alias("outcome")))
    paths = checkpointed(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum("outcome").alias("path_sum")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"), F.count(F.lit(1)).alias("n_paths")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_sum").alias("s"), F.sum("n_paths").alias("paths")).first()
    n, all_ = total["n"] or 0, float(total["s"] or 0)
    k_host, k_path = strength(hosts, "host_sum", "host_n"), strength(paths, "path_sum", "path_n")
    paths = checkpointed(with_records(paths, hosts, ["host"], F.col("n_paths") * small > (total["paths"] or 0)).drop("n_paths"))
    joined = with_records(rows, paths, ["host", "path"], F.col("path_n") * small > n)
    prior = F.expr(f"({all_!r}D - outcome) / {n - 1}") if n > 1 else F.lit(0.5)
    host_mean = F.expr(f"(host_sum - outcome + prior * {k_host!r}D) / (host_n - 1 + {k_host!r}D)")
    path_mean = F.expr(f"(path_sum - outcome + host_mean * {k_path!r}D) / (path_n - 1 + {k_path!r}D)")
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("prior", inside(prior)).withColumn("host_mean", inside(host_mean)).withColumn("path_mean", inside(path_mean))
    logit = lambda c: F.log(c) - F.log1p(-c)
    score = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_mean")) - logit(F.col("prior")))))
    return joined.select("doc_id", "held_out", "evidence", "host_mean", "path_mean", score.alias("score"), (score >= threshold).alias("keep"))
