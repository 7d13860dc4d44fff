"""Exact dedup, suffix dedup and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import components, exact_dedup, ngram_join, packed, suffix_dedup

from .helpers import empty, frame, rows


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("heavy_min", [2, 100])
@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, heavy_min, clash):
    docs = frame(spark, clash=clash)
    got = exact_dedup.exact_dedup(docs, heavy_min=heavy_min).collect()
    groups: dict = {}
    for r in docs.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            stays = i == best and not kept
            kept |= stays
            want.append((i, best, len(ids), stays, sha(text.encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_splits_hot_groups(spark):
    docs = frame(spark, [(k, "hot" if k % 3 == 0 else f"t{k}", "en", "s") for k in range(900)])
    found = exact_dedup.winners(exact_dedup.digests(docs)).collect()
    assert [(r["keep_id"], r["group_size"]) for r in found] == [(897, 300)]
    got = exact_dedup.exact_dedup(docs)
    assert got.where("kept").count() == 601
    assert not any("Python" in line or "Arrow" in line for line in got._jdf.queryExecution().toString().splitlines())


def test_keep_first_keeps_columns_and_one_of_each(spark):
    docs = frame(spark, clash=True)
    got = exact_dedup.keep_first(docs)
    assert got.schema == docs.schema
    texts = [r["text"] or "" for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in docs.collect()})


def test_empty_tables(spark):
    for f in (exact_dedup.exact_dedup, exact_dedup.keep_first, suffix_dedup.dedup_substrings, ngram_join.ngram_join, ngram_join.one_of_each):
        assert f(empty(spark)).count() == 0


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_difference_cover(order):
    v, d = suffix_dedup.difference_cover(order)
    assert len(d) == 6 * order + 4 and {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("depth", [400, 30, 5])
@pytest.mark.parametrize("clash", [False, True])
def test_suffixes(spark, depth, clash):
    docs = frame(spark, clash=clash)
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(t[k : k + depth] for _, t in data for k in range(len(t) - depth + 1))
    want = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - depth + 1):
            if seen[t[k : k + depth]] > 1:
                gone[k : k + depth] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((i, len(t), int(gone.sum()), spans, sha(kept), kept))
    got = suffix_dedup.kept_text(docs, depth)
    assert sorted(((*r[:5], bytes(r[5])) for r in got.collect()), key=str) == sorted(want, key=str)


def covered(texts: list[bytes], depth: int) -> list[np.ndarray]:
    """By brute force, which bytes strings of depth cover that start more than once."""
    seen = Counter(t[k : k + depth] for t in texts for k in range(len(t) - depth + 1))
    out = [np.zeros(len(t), bool) for t in texts]
    for t, gone in zip(texts, out):
        for k in range(len(t) - depth + 1):
            if seen[t[k : k + depth]] > 1:
                gone[k : k + depth] = True
    return out


def passages(seed: int = 5) -> list[str]:
    """Texts that share passages of many sizes, one line that half of them hold, copies, and texts that repeat in themselves."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    prose_ = lambda n: " ".join(word() for _ in range(n))
    shared, line = [prose_(rng.randrange(20, 200)) for _ in range(12)], prose_(70)
    out = [prose_(rng.randrange(0, 60)) + " " + rng.choice([*shared, line, line, line]) + " " + prose_(rng.randrange(0, 300)) for _ in range(60)]
    out += [out[3], out[3], out[4] + "!", out[5][:500], "ab" * 800, prose_(10) + out[6][100:], shared[0] + shared[1] + shared[0], out[7][37:] + out[8]]
    return out


@pytest.mark.parametrize("depth, report", [(400, 300), (200, 61), (400, None)])
@pytest.mark.parametrize("small", [False, True])
def test_suffixes_and_reports_equal_brute_force(spark, monkeypatch, depth, report, small):
    """small: many blocks and buckets, and least strings that count as hot."""
    from sparkloom.llm import common

    if small:
        for module, name, value in ((common, "BLOCK_BYTES", 3000), (common, "BUCKET_ENTRIES", 100), (suffix_dedup, "BUCKET_BYTES", 2000), (suffix_dedup, "HOT_BYTES", 3000)):
            monkeypatch.setattr(module, name, value)
    texts = passages()
    data = [t.encode() for t in texts]
    deep, near = covered(data, depth), covered(data, report or depth)
    want = [(k, int(d.sum()), int(n.sum()), sha(np.frombuffer(t, np.uint8)[~d].tobytes())) for k, (t, d, n) in enumerate(zip(data, deep, near))]
    got = suffix_dedup.dedup_substrings(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), depth, report=report)
    assert rows(got, "doc_id", "n_removed", "n_repeated" if report else "n_removed", "kept_sha256") == sorted(want, key=str)


def test_bucket_is_sorted_by_bytes_and_ranks():
    texts = [t.encode() for t in passages(6)]
    counts = np.array([max(0, len(t) - 399) for t in texts])
    bucket = suffix_dedup.SuffixBucket(texts, counts)
    for length in (13, 30, 5):
        ranks = bucket.prefix_ranks(length)
        strings = [t[k : k + length] for t in texts for k in range(len(t))]
        inside = np.flatnonzero([len(x) == length for x in strings])
        order = {x: k for k, x in enumerate(sorted({strings[k] for k in inside}))}
        pairs = sorted({(order[strings[k]], int(ranks[k])) for k in inside})
        assert len(pairs) == len(order) == len({r for _, r in pairs}) and [r for _, r in pairs] == sorted(r for _, r in pairs)
    ranks, v = bucket.sample_ranks(377), 13
    flat = b"".join(texts)
    end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    sample = [k for k in range(len(flat)) if k % v in (0, 1, 4, 6)]
    assert len(sample) == len(ranks)
    ranks = dict(zip(sample, ranks.tolist()))
    at = [k for k in sample if end[k] - k >= 377]
    by_rank = sorted(at, key=lambda k: (ranks[k], k))
    assert by_rank == sorted(at, key=lambda k: (flat[k : k + 377], k))


def test_suffixes_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    text = suffix_dedup.Text([bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))], 400)
    places = set()
    for at, names in text.sample(181, suffix_dedup.difference_cover(2)[1]):
        assert len(at) == len(names)
    for _, number, offset, left in text.walk():
        places |= set(offset[left >= 400].tolist())
    assert places == set(range(4601))


def test_stretches_of_parts_hold_each_open_suffix_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    texts = [bytes(np.random.default_rng(k).integers(97, 101, n, np.uint8)) for k, n in ((1, 5000), (2, 350), (3, 299), (4, 1400))]
    text = suffix_dedup.Text(texts, 300, 400)
    found = list(text.sample(73, suffix_dedup.difference_cover(1)[1]))
    seen = Counter()
    for number, offset, suffixes, _, raw in text.stretches(73, found, np.ones(sum(len(h) for _, h in found), bool)):
        assert raw == texts[number][offset : offset + suffixes - 1 + 400]
        seen.update((number, offset + k) for k in range(suffixes))
    assert seen == Counter((k, p) for k, t in enumerate(texts) for p in range(len(t) - 299))


def brute_join(docs, n=4, percent=85):
    lower = {k: k + 32 for k in range(65, 91)}
    table = bytes(lower.get(k, k) for k in range(256))
    data, sets = docs.collect(), {}
    for k, r in enumerate(data):
        w = (r["text"] or "").encode().translate(table).split()
        sets[k] = {tuple(w)} if 0 < len(w) < n else {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    up = {r["doc_id"]: r["doc_id"] for r in data if r["doc_id"] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            i, j = data[a]["doc_id"], data[b]["doc_id"]
            if either and 100 * both >= percent * either and i is not None and j is not None:
                i, j = root(i), root(j)
                up[max(i, j)] = min(i, j)
    return sorted(((r["doc_id"], len(sets[k]), None if r["doc_id"] is None else root(r["doc_id"])) for k, r in enumerate(data)), key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_join(spark, clash):
    docs = frame(spark, clash=clash)
    assert rows(ngram_join.ngram_join(docs), "doc_id", "n_shingles", "component_id") == brute_join(docs)


def test_join_with_grid_and_chains(spark):
    import random

    rng, out = random.Random(4), []
    base = [f"w{k}" for k in range(60)]
    for k in range(90):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(500)}"
        out.append((500 - k, " ".join(words[: rng.randrange(50, 61)]), "en", "s"))
    docs = frame(spark, out + [(1000 + k, " ".join(f"u{k * 100 + j}" for j in range(30)), "en", "s") for k in range(20)])
    want = brute_join(docs)
    for block_rows in (1024, 16):
        got = ngram_join.ngram_join(docs, block_rows=block_rows)
        assert rows(got, "doc_id", "n_shingles", "component_id") == want
    assert len({w[2] for w in want}) < len(want)


def test_join_with_hot_columns_and_one_large_component(spark):
    """Documents of a few sentences out of a small stock: every column is in many rows, and chains tie most rows together."""
    import random

    rng = random.Random(8)
    stock = [" ".join(f"s{k}w{j}" for j in range(9)) for k in range(25)]
    out = [(k, ". ".join([stock[0], *(stock[j] for j in sorted(rng.sample(range(1, 25), rng.randrange(5, 9))))]) + f" x{k % 7}" * (k % 2), "en", "s") for k in range(700)]
    docs = frame(spark, out + out[:40])
    want = brute_join(docs)
    for block_rows in (1024, 32):
        got = ngram_join.ngram_join(docs, block_rows=block_rows)
        assert rows(got, "doc_id", "n_shingles", "component_id") == want
    assert 50 < len({w[2] for w in want}) < 700


@pytest.mark.parametrize("left", [0, 13])
def test_sparse_product_equals_counting(left, monkeypatch):
    rng = np.random.default_rng(2)
    for few in (0, 3, 100):
        monkeypatch.setattr(ngram_join, "FEW", few)
        sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(30)]
        sets[7] = sets[3]
        row = np.repeat(np.arange(30), [len(s) for s in sets])
        a, b = (slice(0, left), slice(left, 30)) if left else (slice(0, 30), slice(0, 30))
        got = ngram_join.product(row, np.concatenate(sets), 30, a, b)
        assert (got == [[len(np.intersect1d(x, y)) for y in sets[b]] for x in sets[a]]).all()


def test_join_counts_links(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [(1, text, "", ""), (2, text, "", ""), (3, text + " tail", "", ""), (4, "else", "", "")])
    assert rows(ngram_join.ngram_join(docs), "doc_id", "n_links") == [(1, 2), (2, 2), (3, 2), (4, 0)]


def test_one_of_each(spark):
    docs = frame(spark, clash=True)
    got = ngram_join.one_of_each(docs)
    assert got.schema == docs.schema
    want = [w[0] for w in brute_join(docs) if w[0] is None or w[0] == w[2]]
    assert rows(got, "doc_id") == sorted([(w,) for w in want], key=str)


def test_components(spark):
    import random

    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(100)] + [(5, 5)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}


def test_steps_find_blocks_where_they_lie(spark):
    """What is written by block is grouped, and cogrouped with other rows, without an exchange of its own."""
    from pyspark.sql import functions as F

    from sparkloom.llm import common

    docs = frame(spark)
    dealt = common.dealt_texts(docs, "doc_id", "text", 1)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(dealt.groupBy("blk").applyInArrow(lambda t: t, dealt.schema))
    side = spark.range(8).select(F.col("id").cast("int").alias("blk"))
    assert plan(dealt.groupBy("blk").cogroup(side.groupBy("blk")).applyInArrow(lambda a, b: a, dealt.schema)).count("Exchange hashpartitioning") == 1
    got = [(r["id"], common.expand(r["text"]).decode()) for r in dealt.collect()]
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    made = common.written_by_block(common.blocks(docs, "doc_id", "text", 1), 1, lambda t: t.select(["blk"]).slice(0, 1), "blk int")
    assert "Exchange" not in plan(made.groupBy("blk").applyInArrow(lambda t: t, made.schema))


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from sparkloom.llm import common

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder or d), sparkContext=SimpleNamespace(master=master))

    assert common.shared_folder(session("spark://x", "hdfs://y/c")) == "hdfs://y/c"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            common.shared_folder(session(master))
    assert common.shared_folder(session("local[4]")).endswith("-checkpoints")


def test_packed_messages():
    rng = np.random.default_rng(3)
    for width in (32, 56):
        keys = np.unique(packed.short(rng.integers(0, 1 << 64, 500, np.uint64), 6, width))
        sent = packed.messages(3, keys, np.ones(len(keys), int), width)
        back = np.concatenate([packed.from_planes(x.as_buffer(), width) + (np.uint64(b) << np.uint64(width)) for b, x in zip(sent.column("bucket").to_pylist(), sent.column("rest"))])
        assert (back == keys).all()
    assert packed.coded(np.array([1, 2, 127, 128, 10**6])).tolist() == [0, 2, 127, 128, 231]


def test_a_task_gives_its_memory_back():
    """What a task has freed leaves the process at its end: else workers that wait hold the most that any task took."""
    import subprocess
    import sys

    code = """
import re
import numpy as np
import pyarrow as pa
from sparkloom.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def work(table):
    common.keep_memory()
    kept = [np.ones(100_000) for _ in range(150)]
    kept[:-1] = []
    work.last = kept
    return table

def batches_of(batches):
    for batch in batches:
        work(batch)
        yield batch

work(None)
plain = held()
common.frugal(work)(None)
group = held()
list(common.frugal(batches_of)([None]))
print(plain, group, held())
"""
    plain, group, batches = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert group < plain - 80 and batches < plain - 80
