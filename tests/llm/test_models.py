"""Classifiers, the language model and decontamination."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language_id, language_model, quality, queries, toxicity
from sparkloom.llm.common import crc_mod

from .helpers import empty, frame, prose, rows

EN, DE = "the of and that with house river north".split(), "der die und nicht mit haus fluß straße".split()


def two_languages(n=60):
    import random

    rng = random.Random(1)
    return [(k, " ".join(rng.choice(EN if k % 2 else DE) for _ in range(rng.randrange(3, 300))), "en" if k % 2 else "de", "s") for k in range(n)]


def test_language(spark):
    docs = frame(spark, two_languages() + [(100, None, "en", "s"), (101, "", "de", "s"), (102, "12 ,.", "en", "s"), (None, "und nicht der fluß", None, "s"), (103, "the river and the house", None, "s")])
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[None]["lang_pred"] == "de" and got[103]["lang_pred"] == "en"
    right = [got[k]["lang_pred"] == lang for k, _, lang, _ in two_languages() if got[k]["held_out"]]
    assert len(right) > 5 and np.mean(right) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["held_out"] for k in range(60)] == [bool(x) for x in crc_mod(range(60), 4) == 2]


def test_language_without_labels_and_rows(spark):
    docs = frame(spark, clash=True)
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and set(r["lang_pred"] for r in language_id.identify(docs, none).collect()) == {"und"}
    assert language_id.identify(empty(spark), none).count() == 0
    model = language_id.ByteCnn(["a", "b"])
    kept = language_id.with_language(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())


def test_network_scores_alike_by_either_path():
    model = language_id.ByteCnn(["a", "b", "c"])
    w = np.random.default_rng(0).integers(0, 256, (5, language_id.WINDOW), np.uint8)
    assert np.allclose(model.pooled(w)[0], model.scored(w), atol=1e-4)


def test_windows_cover_whole_texts():
    data = np.frombuffer(bytes(range(1, 250)) * 5, np.uint8)
    offsets = np.array([0, 0, 513, 1245])
    got = {}
    for windows, row, real in language_id.windows_of(data, offsets, 100, 3):
        for w, r, n in zip(windows, row, real):
            got[r] = got.get(r, b"") + w[:n].tobytes()
            assert not w[n:].any()
    assert got == {1: data[:513].tobytes(), 2: data[513:].tobytes()}


def toxic_rows(n=400):
    """Toxic where an insult and a mention stand together; each alone is fine."""
    import random

    rng, out = random.Random(3), []
    for k in range(n):
        words = prose(k, 20).split()
        kind = k % 4
        if kind in (1, 3):
            words.insert(rng.randrange(20), "Insultword")
        if kind in (2, 3):
            words.insert(rng.randrange(20), "groupname,")
        out.append((k, " ".join(words), int(kind == 3)))
    return out


def test_toxicity_learns_pairs(spark):
    data = toxic_rows()
    docs = frame(spark, [(k, t, "en", "s") for k, t, _ in data] + [(900, None, "en", "s"), (901, "", "en", "s"), (None, "x", "en", "s")])
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in data] + [(None, 1, 1), (5000, 1, 1), (900, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[k]["predicted"], y) for k, _, y in data if got[k]["held_out"]]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) >= 0.95
    assert got[900]["predicted"] == 0 and got[900]["score"] == got[901]["score"] and None in got
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_factorization_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.arange(10, dtype=np.uint64), 0.3, rng.normal(size=10).astype(np.float32), rng.normal(size=(10, 4)).astype(np.float32))
    rows_ = [[1, 4, 7], [], [0, 1, 2, 3, 9]]
    want = [0.3 + sum(m.weight[i] for i in r) + sum(float(m.factors[i] @ m.factors[j]) for i in r for j in r if i < j) for r in rows_]
    assert np.allclose(m.raw(np.concatenate(rows_).astype(int), np.array([0, 3, 3, 8])), want, atol=1e-5)


def test_toxicity_stands_clashes_repeats_and_long_texts(spark):
    """With a trained model: equal rows get equal scores, other columns change none, and a long text's last words count."""
    data = toxic_rows()
    plain = [(k, t, "en", "s") for k, t, _ in data]
    more = [(7000, "calm " * 300_000 + data[0][1], "en", "s"), *plain[:3], *plain[:3], (None, None, None, None), (None, plain[0][1], None, None)]
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in data], "doc_id long, quality int, toxic int")
    got = []
    for clash in (False, True):
        docs = frame(spark, plain + more, clash)
        got.append(rows(toxicity.score(docs, toxicity.train(docs, labels)), "doc_id", "held_out", "score", "predicted"))
    assert got[0] == got[1] and len(got[0]) == len(plain) + len(more)
    by_id: dict = {}
    for i, _, score, _ in got[0]:
        by_id.setdefault(i, set()).add(score)
    assert all(len(by_id[i]) == 1 for i, *_ in plain) and by_id[plain[0][0]] < by_id[None]


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, clash=True)
    model = toxicity.train(docs, labels)
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(empty(spark), model).count() == 0


def test_quality(spark):
    good = [(k, prose(k, 40 + k % 30).capitalize() + ".", "en", f"s{k % 5}") for k in range(0, 200, 2)]
    bad = [(k, "!!! ".join(prose(k, 30).upper().split()) + "###", "en", f"s{k % 5}") for k in range(1, 200, 2)]
    docs = frame(spark, good + bad + [(900, None, None, None), (901, "", "en", None)])
    labels = spark.createDataFrame([(k, k % 2 ^ 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.quality(docs, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 202 and np.mean([got[k]["keep"] == (k % 2 == 0) for k in range(200) if got[k]["held_out"]]) == 1
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got.values())
    same = quality.quality(docs, model, F.col("source"), F.col("lang"), small=0)
    assert {r["doc_id"]: round(r["score"], 9) for r in same.collect()} == {k: round(r["score"], 9) for k, r in got.items()}


def brute_quality(docs, labels: dict) -> dict:
    """doc number -> (host mean, path mean, score), with the operator's own evidence and prior strengths by their formula."""
    out = [labels.get(d["doc_id"], d["evidence"]) if not d["held_out"] else d["evidence"] for d in docs]

    def sums(key):
        got: dict = {}
        for d, o in zip(docs, out):
            n, s = got.get(key(d), (0, 0.0))
            got[key(d)] = (n + 1, s + o)
        return got

    def kappa(groups):
        n, m = sum(g[0] for g in groups), sum(g[1] for g in groups) / sum(g[0] for g in groups)
        spread = sum(k * (s / k - m) ** 2 for k, s in groups) - sum(s / k * (1 - s / k) for k, s in groups)
        within = max(m * (1 - m), 1e-9)
        return min(max(within / max(spread / n, within / 1e4) - 1, 1.0), 1e4)

    host, path = sums(lambda d: d["host"]), sums(lambda d: (d["host"], d["path"]))
    kh, kp, n, total = kappa(host.values()), kappa(path.values()), len(docs), sum(out)
    logit, found = lambda p: math.log(p) - math.log1p(-p), []
    inside = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    for d, o in zip(docs, out):
        prior = inside((total - o) / (n - 1))
        hn, hs = host[d["host"]]
        pn, ps = path[d["host"], d["path"]]
        hm = inside((hs - o + prior * kh) / (hn - 1 + kh))
        pm = inside((ps - o + hm * kp) / (pn - 1 + kp))
        found.append((d["doc_id"], hm, pm, 1 / (1 + math.exp(-(logit(d["evidence"]) + logit(pm) - logit(prior))))))
    return found


@pytest.mark.parametrize("clash", [False, True])
def test_quality_equals_brute_force(spark, clash):
    """Repeated rows, null ids, null hosts and paths, a very long text, labels and none."""
    texts = [(k % 70, prose(k, 20 + k % 9).upper() if k % 4 else prose(k, 30), ("en", "de", None)[k % 3], None if k % 11 == 0 else f"s{k % 5}") for k in range(90)]
    data = [*texts, (None, "a", "en", "s1"), (None, None, None, None), (500, prose(4, 20000), "en", "only")]
    docs = frame(spark, data, clash)
    labels = {k: k % 2 for k in range(0, 60, 3)}
    model = quality.train(docs, spark.createDataFrame([(k, int(k % 4 == 0), 0) for k in range(70)], "doc_id long, quality int, toxic int"))
    seen = quality.evidence(docs, model, F.col("source"), F.col("lang")).collect()
    want = sorted(((i, *(round(x, 7) for x in v)) for i, *v in brute_quality([r.asDict() for r in seen], labels)), key=str)
    for small in (100_000, 3, 0):
        got = quality.quality(docs, model, F.col("source"), F.col("lang"), small=small, labels=spark.createDataFrame([(k, v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int"))
        assert sorted(((r["doc_id"], *(round(r[c], 7) for c in ("host_mean", "path_mean", "score"))) for r in got.collect()), key=str) == want


def test_quality_site_decides(spark):
    """One text at three sites, good, bad and unknown: the records of the others there make the difference."""
    same = "a text like any other"
    docs = frame(spark, [(k, same, "en", "good" if k < 40 else "bad" if k < 80 else f"lone{k}") for k in range(82)])
    labels = spark.createDataFrame([(k, int(k < 38 or 40 <= k < 42), 0) for k in range(79)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, 0.5, F.col("source"), F.col("lang"), labels=labels).collect()}
    assert got[39]["keep"] and got[39]["score"] > 0.7 and not got[79]["keep"] and got[79]["score"] < 0.3
    assert abs(got[80]["score"] - 0.5) < 0.01 and got[80]["evidence"] == got[39]["evidence"]


def test_quality_own_outcome_does_not_count(spark):
    """A site of one document says nothing of it, whatever its label."""
    docs = frame(spark, [(k, "words", "en", f"s{k}") for k in range(30)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, 0.5, F.col("source"), F.col("lang"), labels=labels).collect()
    assert len(got) == 30 and all(abs(r["score"] - 0.5) < 0.02 for r in got)


def test_quality_shrinks_sparse_sites(spark):
    docs = frame(spark, [(k, "x", "en", "big") for k in range(300)] + [(900, "y", "en", "tiny")])
    model = 0.4
    got = {r["doc_id"]: r for r in quality.quality(docs, model, F.col("source"), F.col("lang")).collect()}
    assert abs(got[900]["host_mean"] - 0.4) < 1e-9
    assert quality.quality(empty(spark), 0.5, F.col("source"), F.col("lang")).count() == 0


def test_convolution_equals_brute_force():
    """Filters placed one by one over windows, rectified, their maxima, and the softmax."""
    rng = np.random.default_rng(4)
    model = language_id.ByteCnn(["a", "b", "c"], filters=5, widths=(2, 3, 4), seed=9)
    for b in model.bias:
        b += rng.normal(0, 0.2, len(b)).astype(np.float32)
    windows = rng.integers(0, 256, (6, 40)).astype(np.uint8)
    want = []
    for window in windows:
        feats = []
        for tables, bias in zip(model.filters, model.bias):
            w = len(tables)
            feats += [max(0.0, max(sum(float(tables[j][window[at + j]][f]) for j in range(w)) for at in range(len(window) - w + 1)) + float(bias[f])) for f in range(5)]
        z = np.array(feats) @ model.out + model.out_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.abs(model.probabilities(windows) - np.array(want)).max() < 1e-5


def test_identify_stands_clashes_repeats_and_long_texts(spark):
    data = two_languages()
    more = [data[3], data[3], (None, data[4][1], "de", "s"), (None, None, None, None), (500, " ".join(DE[k * k % 7] + " " + DE[k % 8] for k in range(60_000)), "de", "s"), (501, "", "en", "s")]
    got = []
    for clash in (False, True):
        docs = frame(spark, data + more, clash)
        got.append(rows(language_id.identify(docs, language_id.train(docs)), "doc_id", "held_out", "lang_pred", "score"))
    assert got[0] == got[1] and len(got[0]) == len(data) + len(more)
    assert [r[2] for r in got[0] if r[0] == 500] == ["de"] and [r[2:] for r in got[0] if r[0] == 501] == [("und", 0.0)]
    assert len({r for r in got[0] if r[0] == data[3][0]}) == 1


def test_chosen_rows_are_those_of_the_least_hash(spark):
    from sparkloom.llm.labelled import first_by_hash

    df = spark.range(30000).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 40, "b").otherwise("c").alias("g"), F.xxhash64("id").alias("h"))
    got: dict = {}
    for r in first_by_hash(df, "g", 500).collect():
        got.setdefault(r["g"], set()).add(r["_id"])
    want: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["h"]):
        if len(want.setdefault(r["g"], set())) < 500:
            want[r["g"]].add(r["_id"])
    assert got == want


def brute_base(data):
    table = bytes(k + 32 if 65 <= k < 91 else k for k in range(256))
    tokens = [(i, [*(t or "").encode().translate(table).split(), None]) for i, t in data]
    held = [bool(x) for x in crc_mod([i for i, _ in data], 10) == 0]
    c = Counter(w for (_, t), h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, t), h in zip(tokens, held)]


@pytest.mark.parametrize("clash", [False, True])
def test_language_model_counts(spark, clash):
    docs = frame(spark, clash=clash)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in language_model.score(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_base([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    assert language_model.score(empty(spark)).count() == 0


def test_language_model_predicts_and_sums_to_one(spark):
    """Over documents of one unseen context word and each known word, the probabilities of the second token sum to one."""
    train = [(k, "red apples fall . green apples grow . red leaves fall .", "en", "s") for k in range(40) if crc_mod([k], 10)[0] != 0]
    words = "red apples fall . green grow leaves".split()
    held = [k for k in range(1000, 3000) if crc_mod([k], 10)[0] == 0]
    probes = [(k, f"red {w}", "en", "s") for k, w in zip(held, [*words, "unknownword"])] + [(held[20], "red", "en", "s"), (held[21], "unknownword", "en", "s")]
    got = {r["doc_id"]: r["score"] for r in language_model.score(frame(spark, train + probes)).collect()}
    # P(red | begin) P(w | red) P(end | w): compare orders of magnitude instead of dividing by unknown ends.
    assert got[held[1]] > got[held[0]] and got[held[6]] > got[held[7]]
    seen = [got[k] for k, _, _, _ in train]
    assert min(seen) > -12 and all(s <= 0 for s in got.values())


def test_probabilities_sum_to_one(spark):
    """After a known, a rare and an unknown context word and at the beginning, over all words, the unknown one and the end."""
    train = [k for k in range(400) if crc_mod([k], 10)[0] != 0][:60]
    texts = {k: " ".join(prose(k, 12).split()) for k in train}
    words = sorted({w for t in texts.values() for w in t.split()})
    held = iter([k for k in range(1000, 9000) if crc_mod([k], 10)[0] == 0])
    contexts = [None, "the", texts[train[0]].split()[3], "neverseen"]
    probes = {next(held): (c, w) for c in contexts for w in [*words, "neverseen", None]}
    docs = frame(spark, [(k, t, "en", "s") for k, t in texts.items()] + [(k, " ".join(x for x in p if x), "en", "s") for k, p in probes.items()])
    found = language_model.score(docs, tokens=True).collect()
    for r in found:
        assert len(r["log_p"]) == r["n_tokens"] and abs(sum(r["log_p"]) - r["score"]) < 1e-9 and abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"]
    got = {r["doc_id"]: r["log_p"] for r in found}
    for c in contexts:
        total = sum(10 ** got[k][0 if c is None else 1] for k, p in probes.items() if p[0] == c)
        assert abs(total - 1) < 1e-5, c


def gibbs(texts: list[list[str]], sweeps: int, burn: int, probes: list[tuple]) -> list[float]:
    """A Gibbs sampler of single customers, table by table, at both levels: the mean predictions of probes (context, word)."""
    import random

    rng = random.Random(1)
    d, theta, d0, theta0 = language_model.DISCOUNT, language_model.THETA, language_model.ROOT_DISCOUNT, language_model.ROOT_THETA
    tokens = [(u, w) for t in texts for u, w in zip([None, *t], [*t, "END"])]
    v = len({w for _, w in tokens})
    seats: dict = {}  # restaurant -> dish -> sizes of tables; the parent is "ROOT"

    def total(u, of=sum):
        return sum(of(x) for x in seats.get(u, {}).values())

    def p_root(w):
        x = seats.get("ROOT", {}).get(w, [])
        return (sum(x) - d0 * len(x) + (theta0 + d0 * total("ROOT", len)) * 0.5 / v) / (theta0 + total("ROOT"))

    def sit(u, w):
        x = seats.setdefault(u, {}).setdefault(w, [])
        a, b, new = (d0, theta0, 0.5 / v) if u == "ROOT" else (d, theta, p_root(w))
        weights = [n - a for n in x] + [(b + a * total(u, len)) * new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k < len(x):
            x[k] += 1
        else:
            x.append(1)
            if u != "ROOT":
                sit("ROOT", w)

    def leave(u, w):
        x = seats[u][w]
        k = rng.choices(range(len(x)), x)[0]
        x[k] -= 1
        if not x[k]:
            x.pop(k)
            if u != "ROOT":
                leave("ROOT", w)

    for u, w in tokens:
        sit(("in", u), w)
    sums = [0.0] * len(probes)
    for sweep in range(sweeps):
        for u, w in tokens:
            leave(("in", u), w)
            sit(("in", u), w)
        if sweep >= burn:
            for k, (u, w) in enumerate(probes):
                x = seats.get(("in", u), {}).get(w, [])
                c_u, t_u = total(("in", u)), total(("in", u), len)
                sums[k] += (sum(x) - d * len(x) + (theta + d * t_u) * p_root(w)) / (theta + c_u)
    return [s / (sweeps - burn) for s in sums]


def test_predictions_equal_a_sampler_of_single_customers(spark):
    train = [k for k in range(100) if crc_mod([k], 10)[0] != 0][:14]
    texts = {k: prose(k, 14).replace("7", "").split() for k in train}
    held = [k for k in range(1000, 9000) if crc_mod([k], 10)[0] == 0]
    counts = Counter(zip([w for t in texts.values() for w in t[:-1]], [w for t in texts.values() for w in t[1:]]))
    pairs = [p for p, _ in counts.most_common(6)] + [("the", "zzz"), ("stone", "seven"), ("hills", "the")]
    pairs = [p for p in pairs if all(any(w in t for t in texts.values()) for w in p)]
    want = gibbs(list(texts.values()), 400, 100, pairs)
    docs = frame(spark, [(k, " ".join(t), "en", "s") for k, t in texts.items()] + [(k, f"{u} {w}", "en", "s") for k, (u, w) in zip(held, pairs)])
    got = {r["doc_id"]: 10 ** r["log_p"][1] for r in language_model.score(docs, chains=32, sweeps=3, tokens=True).collect() if r["held_out"]}
    ratio = np.array([got[k] for k, _ in zip(held, pairs)]) / np.array(want)
    assert len(pairs) >= 6 and (np.abs(ratio - 1) < 0.15).all() and abs(ratio.mean() - 1) < 0.08, ratio


def test_query_makes_the_sweeps_that_are_tested(spark, tmp_path):
    """The registered query samples as long as the run above that is compared with the sampler of single customers."""
    rows = [(k, prose(k % 40, 30), "en", "s") for k in range(120)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    scores = lambda found: {r["doc_id"]: round(r["score"], 9) for r in found.collect()}
    got = scores(queries.op6_language_model(spark, str(tmp_path)))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert got == scores(language_model.score(docs, sweeps=3))


def test_tables_follow_their_conditional():
    """For small counts, frequencies of t against the weights, summed up; for large ones, the mean by the recursion itself."""
    n = 20000
    for c, x, p, d in ((2, 2.0, 0.3, 0.8), (5, 40.0, 0.01, 0.8), (9, 11.0, 0.5, 0.6)):
        t = language_model.tables(np.full(n, c), np.full(n, x), np.full(n, p), d, np.arange(n, dtype=np.uint64))
        ways = {1: {1: 1.0}}
        for k in range(1, c):
            ways[k + 1] = {m: ways[k].get(m - 1, 0) + max(0, k - d * m) * ways[k].get(m, 0) for m in range(1, k + 2)}
        weight = np.array([ways[c][m] * np.prod([(x + d * i) * p for i in range(m)]) for m in range(1, c + 1)])
        assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.015
    for c, x, p in ((1000, 300.0, 0.02), (1500, 5000.0, 0.0004), (900, 4000.0, 0.2), (700, 5.0, 0.3), (1200, 2000.0, 0.1), (600, 2.0, 0.001)):
        s = language_model.log_stirling(0.8, c)[c, 1:]
        log_w = s + np.cumsum(np.log((x + 0.8 * np.arange(c)) * p))
        w = np.exp(log_w - log_w.max())
        mean = (w * np.arange(1, c + 1)).sum() / w.sum()
        spread = np.sqrt((w * np.arange(1, c + 1) ** 2).sum() / w.sum() - mean**2)
        t = language_model.tables(np.full(3000, c), np.full(3000, x), np.full(3000, p), 0.8, np.arange(3000, dtype=np.uint64))
        assert abs(t.mean() / mean - 1) < 0.03 and abs(t.std() - spread) < max(0.15 * spread, 0.3), (c, x, t.mean(), mean, t.std(), spread)


def test_tables_lie_between_one_and_customers():
    count = np.array([0, 1, 2, 5, 60, 1000, 100000])
    t = language_model.tables(count, np.full(7, 1.5), np.ones(7), 0.7, np.arange(7, dtype=np.uint64))
    assert t[0] == 0 and t[1] == 1 and (t[2:] >= 1).all() and (t <= count).all()
    flat = language_model.tables(np.full(4000, 10), np.full(4000, 2.0), np.ones(4000), 0.0, np.arange(4000, dtype=np.uint64))
    assert abs(flat.mean() - sum(2 / (2 + k) if k else 1 for k in range(10))) < 0.1


def test_seats_round_trip():
    rng = np.random.default_rng(5)
    customers = rng.choice([0, 1, 1, 1, 2, 7, 254, 255, 70000], 500).astype(np.uint32)
    seats = [np.where(customers > 1, rng.integers(1, 9000, 500), np.minimum(customers, 1)).astype(np.uint32) for _ in range(3)]
    owner = ((customers > 1) & (rng.random(500) < 0.5)).astype(np.uint8)
    got = language_model.unpack_seats(language_model.pack_seats(customers, owner, *seats), 500, 3)
    assert all((a == b).all() for a, b in zip(got, (customers, owner, *seats), strict=True))
    raw = bytes(rng.integers(0, 5, 3000, np.uint8))
    assert bytes(language_model.expand(language_model.squeeze(raw))) == raw and language_model.squeeze(b"") == b""


ITEM = "A train leaves Paris at 9 and travels 120 km to Lyon while another train leaves Lyon at 11 and travels 80 km toward Paris before they meet"


def contaminated(spark, texts, items=(ITEM,), **options):
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)], clash=True)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, **options).collect()}


def test_decontamination(spark):
    refilled = ITEM.replace("Paris", "Berlin").replace("Lyon", "Munich").replace("120", "300").replace("80", "55")
    mixed = "A train leaves Berlin at 9 and travels 120 km to Rome while another train leaves Oslo at 11 and travels 80 km toward Bern before they meet"
    got = contaminated(spark, [ITEM, f"{prose(1, 30)} {ITEM} {prose(2, 30)}", refilled, ITEM.upper(), ITEM.lower(), prose(3, 400), None, "", ITEM[:40], mixed])
    assert [got[k]["contaminated"] for k in range(9)] == [True] * 5 + [False] * 4
    assert got[2]["refilled"] and got[2]["similarity"] == 1 and got[0]["item_id"] == 0
    assert got[9]["similarity"] < 1  # its slots contradict each other
    slots = "If Anna has 5 apples and Anna gives 5 apples to Ben then what does Anna now hold of those 5 apples"
    right, wrong = slots.replace("5", "7").replace("Anna", "Eva"), "If Eva has 5 apples and Tom gives 7 apples to Ben then what does Kim now hold of those 9 apples"
    got = contaminated(spark, [right, wrong], (slots,))
    assert got[0]["contaminated"] and not got[1]["contaminated"]


def test_decontamination_edges(spark):
    for small in (500_000, 0):
        got = contaminated(spark, [ITEM, prose(5, 60), "nothing", "A, B.", "a b c", "it is a b here"], (ITEM, prose(5, 60), None, "", "a b"), small=small)
        assert [got[k]["item_id"] for k in range(6)] == [0, 1, None, 4, None, None] and [got[k]["contaminated"] for k in range(6)] == [True, True, False, True, False, False]
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, clash=True)
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
    bench = spark.createDataFrame([(1, prose(1, 90))], "item_id long, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def examined(text, *items):
    return decontaminate.examine(decontaminate.Bench(list(range(len(items))), list(items)), pa.array([text]))[0]


def test_a_run_is_kept_beside_a_greater_share_of_another_item():
    long, short = prose(11, 60), "we went home by bus today at noon sharp"
    got = examined(" ".join([*long.split()[:16], "xx", "yy", *short.split()[:7]]), long, short)
    assert got[4] and got[2] == 16 and got[0] == 1 and got[1] == 0.6
    assert got[5] == 0


def test_a_run_is_kept_beside_a_greater_template_share():
    plain = "we saw ants carry small green boxes to that old barn near our"
    item = f"{plain} {' '.join(map(str, range(20)))} house where two brown bears sleep through every long cold winter night until spring"
    got = examined(f"{plain} yard", item)
    assert got[4] and got[2] == 13 and got[1] < 0.8


BOX = "If a box holds 3 red balls and 5 blue balls how many balls are there"


def test_item_values_may_become_one_value():
    got = examined(BOX.replace("3", "4").replace("5", "4"), BOX)
    assert got[1] == 1 and got[3] and got[4]


def test_two_refillings_in_one_text_do_not_mix():
    def refill(a, b):
        return BOX.replace("3", "#").replace("5", str(b)).replace("#", str(a))

    for text in (f"{refill(9, 7)} {refill(8, 6)}", f"{refill(6, 9)} or {refill(7, 8)}", f"{refill(7, 6)} {prose(1, 30)} {refill(6, 9)} {refill(9, 6)}"):
        got = examined(text, BOX)
        assert got[1] == 1 and got[4], text


def test_common_windows_elsewhere_do_not_outvote_a_passage():
    passage = BOX.replace("3", "12").replace("5", "40")
    noise = " . ".join("then a box holds 77 red balls and 88 blue balls how nice" for _ in range(50))
    got = examined(f"{noise} . {passage} . {noise}", BOX)
    assert got[1] == 1 and got[4]
    assert not examined(noise, BOX)[4]


def test_slots_of_one_value_still_contradict():
    item = "If Anna has 5 apples and Anna gives 5 apples to Ben then what does Anna now hold of those 5 apples"
    assert not examined("If Eva has 5 apples and Tom gives 7 apples to Ben then what does Kim now hold of those 9 apples", item)[4]


GIVES = "Anna gives half of all the red apples to a friend. Anna keeps 1,200 apples now"


@pytest.mark.parametrize("item, text", [
    (GIVES, GIVES.replace("Anna", "Eva")),
    (GIVES, GIVES.replace("1,200", "950")),
    (GIVES, GIVES.replace("1,200", "3.50").replace("Anna", "Eva Maria")),
    ("we heard that Mr. Smith bought three old houses near the river and sold two", "we heard that Dr. Jones bought three old houses near the river and sold two"),
    ("we heard that Mr. Smith bought three old houses near the river and sold two", "we heard that Eva bought three old houses near the river and sold two"),
    ("a shop sells bread for 3.50 euros and we pay for two of them today", "a shop sells bread for 4 euros and we pay for two of them today"),
])
def test_refilled_openers_names_and_numbers(item, text):
    for t in (text, f"{prose(1, 30)}. {text}. {prose(2, 30)}"):
        got = examined(t, item)
        assert got[1] == 1 and got[3] and got[4]
    assert examined(item, item)[1] == 1


def test_numbers_and_names_end_with_their_text():
    found = decontaminate.examine(decontaminate.Bench([0], [GIVES]), pa.array(["5", GIVES[:50] + " 1", ",200", "", GIVES, "Anna", "3.", "4"]))
    assert [bool(f and f[4]) for f in found] == [False] * 4 + [True] + [False] * 3


@pytest.mark.parametrize("small", [500_000, 0])
def test_rows_are_kept_apart_and_equal_the_form_in_memory(spark, small):
    """Broadcast or shuffled: a row for each row, also for null ids, repeated ids and repeated rows, equal to examine()."""
    items = (ITEM, prose(5, 60), BOX, BOX, GIVES, "Eva has two cats", prose(6, 25) + " 12 km " + prose(7, 9), f"{prose(8, 14)} Anna {prose(9, 14)}")
    texts = [(None, ITEM), (None, "nothing"), (None, None), (1, prose(5, 60)), (1, "nothing"), (1, "nothing"), (2, ITEM), (2, ITEM), (3, f"{ITEM} {BOX}")]
    texts += [(10 + k, f"{prose(k, 9)}. {t}. {prose(k, 3000 if k == 2 else 12)}") for k, t in enumerate((BOX.replace("3", "4"), GIVES.replace("Anna", "Eva"), ITEM.replace("120", "90"), prose(6, 25) + " 7 km " + prose(7, 9), prose(8, 14) + " Tom", "Eva has two cats", BOX.replace("red", "green")))] + [(30, "eva HAS two, cats!")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in texts], clash=True)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.examine(decontaminate.Bench(list(range(len(items))), list(items)), pa.array([t for _, t in texts]))
    want = [(i, bool(f and f[4]), f[0] if f else None, round(f[1], 9) if f else 0.0, f[2] if f else 0, bool(f and f[3]), f[5] if f else None) for (i, _), f in zip(texts, found)]
    got = [(*r[:3], round(r[3], 9), *r[4:]) for r in decontaminate.contamination(docs, bench, small=small).collect()]
    told = lambda all_: sorted((w if w[1] else w[:2] for w in all_), key=str)
    assert told(got) == told(want) and 8 < sum(w[1] for w in want) < len(want)
    kept = decontaminate.clean(docs, bench, small=small)
    assert kept.schema == docs.schema and rows(kept, "doc_id", "text") == sorted([t for t, w in zip(texts, want) if not w[1]], key=str)


@pytest.mark.parametrize("small", [500_000, 0])
def test_common_windows_make_no_pairs_and_lose_none(spark, small):
    """Items of one stock of sentences, so that most windows are in many; texts that hold shares near the bounds."""
    import random

    rng = random.Random(5)
    stock = [prose(900 + k, 12) for k in range(9)]
    items = [" ".join([*rng.sample(stock, 2), prose(40 + k, rng.randrange(2, 12))]) for k in range(25)]
    texts = []
    for k in range(120):
        words = items[rng.randrange(25)].split()
        first = rng.randrange(0, len(words) // 2)
        cut = words[first : first + rng.randrange(8, len(words))]
        if rng.random() < 0.5:
            cut[rng.randrange(len(cut))] = "changed"
        texts.append(f"{prose(k, 6)} {' '.join(cut)} {rng.choice(stock)} {prose(500 + k, 5)}")
    found = decontaminate.examine(decontaminate.Bench(list(range(25)), items), pa.array(texts))
    want = {k: bool(f and f[4]) for k, f in enumerate(found)}
    assert 20 < sum(want.values()) < 110
    got = contaminated(spark, texts, tuple(items), small=small)
    assert {k: r["contaminated"] for k, r in got.items()} == want
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = decontaminate.keyed(decontaminate.benchmark_tables(bench, "item_id", "text")[1], 0.8, 13)
    assert w.where("key").count() < 0.6 * w.count()


def brute_refillings(text: str, item: str) -> float:
    """Share of the item's template windows that one choice of document values explains, by trying every choice."""
    import itertools

    def read(t):
        c = decontaminate.Canonical(*decontaminate.text_bytes(pa.array([t])))
        at, _, x = decontaminate.candidates(c, 0, True)
        return [(int(h), decontaminate.slots(c, 0, k, True)) for k, h in zip(at.tolist(), x.tolist())]

    mine, yours = read(item), read(text)
    hits = [(k, decontaminate.filled(s, b"\0".join(x[1:] if x else b"" for x in z.split(b"\0")))) for k, (h, s) in enumerate(mine) for g, z in yours if g == h]
    left = sorted({x for _, f in hits for x, _ in f})
    values = {x: sorted({y for _, f in hits for w, y in f if w == x}) for x in left}
    best = 0
    for choice in itertools.product(*(values[x] for x in left)):
        told = dict(zip(left, choice))
        best = max(best, len({k for k, f in hits if all(told[x] == y for x, y in f)}))
    return best / len(mine)


def test_slots_equal_brute_force():
    """One copy of an item with any values in its slots, also contradictory ones: the share is that of the best re-filling."""
    import random

    rng, seen = random.Random(3), set()
    item = "we gave 3 red balls to our friend then she gave 5 of them and 3 more to the boy who had 5 of his own and 7 others before those 7 days"
    for _ in range(40):
        text = " ".join(str(rng.choice((2, 4, 6))) if w.isdigit() else w for w in item.split())
        got = examined(text, item)
        seen.add(got[1])
        assert abs(got[1] - brute_refillings(text, item)) < 1e-9, text
    assert len(seen) > 2


def test_window_hits_equal_brute_force():
    texts = [prose(k, 60) for k in range(20)]
    bench = decontaminate.Bench([1, 2], [texts[3], " ".join(texts[5].split()[:30])])
    found = decontaminate.examine(bench, pa.array(texts))
    for k, t in enumerate(texts):
        w = t.split()
        grams = {tuple(w[j : j + 5]) for j in range(56)}
        best = max(len(grams & {tuple(x[j : j + 5]) for j in range(len(x) - 4)}) / (len(x) - 4) for x in (texts[3].split(), texts[5].split()[:30]))
        assert (found[k] is not None and found[k][4]) == (best >= 0.8)


def test_rows_helper(spark):
    assert rows(frame(spark, [(1, "a", "en", "s")]), "doc_id") == [(1,)]
