"""Tokenizers against their libraries, and the pipeline against its operators."""

from __future__ import annotations

import hashlib
import random
from array import array

import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkloom.llm import queries, sentencepiece_bpe, token_count

from .helpers import empty, frame, prose, rows, texts

public = pytest.importorskip("public_tokenizers")
MODEL, BYTES = str(public.path("piece_bpe_32k.model")), str(public.path("byte_bpe_50k.json"))
LETTERS = "ab cde  ▁\n\t\r.,;²½³1234５éüñ中日本語🙂̀​\x00\x1c\x85 <s></s>|endoftext'sStTreRE_-*#{}()"


def fuzz(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)] + ["<|endoftext|>a<|endoftext|>", " ", "   ", "aaaa" * 50, "▁" * 70, prose(1, 3000)]


def test_sentencepiece_equals_the_library():
    ours, theirs = sentencepiece_bpe.loaded(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in [*fuzz(1500), *(t or "" for t in texts())]:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids
        assert ours.decode([1, *ids, 2]) == theirs.decode([1, *ids, 2])


def test_coarse_cuts_agree():
    ours = sentencepiece_bpe.SentencePieceBpe(MODEL)
    fine = [ours.encode(t) for t in fuzz(200)]
    ours.part = sentencepiece_bpe.COARSE
    ours.memo.clear()
    assert [ours.encode(t) for t in fuzz(200)] == fine


@pytest.mark.parametrize("clash", [False, True])
def test_encode_documents(spark, clash):
    docs, theirs = frame(spark, clash=clash), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for r in docs.collect():
        ids = [1, *theirs.encode(r["text"] or ""), 2]
        want.append((r["doc_id"], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest()))
    got = sentencepiece_bpe.encode_documents(docs, MODEL, with_ids=True)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert rows(sentencepiece_bpe.decode_documents(got, MODEL), "doc_id", "text") == sorted(((r["doc_id"], theirs.decode(r["ids"])) for r in got.collect()), key=str)
    assert sentencepiece_bpe.encode_documents(empty(spark), MODEL).count() == 0


def test_counts_equal_the_library():
    ours, theirs = token_count.loaded(BYTES), Tokenizer.from_file(BYTES)
    for t in fuzz(1500):
        assert ours.count(t) == len(theirs.encode(t, add_special_tokens=False).ids)


def test_prefix_counts_need_no_encoding_anew():
    ours, theirs = token_count.loaded(BYTES), Tokenizer.from_file(BYTES)
    for t in fuzz(60, 5)[:60] + ["don't we'll  you're\n\n they've", prose(4, 60)]:
        if "<|" in t:
            continue
        counts = ours.prefix_counts(t)
        exact = [len(theirs.encode(t[:e], add_special_tokens=False).ids) for e in range(len(t) + 1)]
        assert [counts.at(e) for e in range(len(t) + 1)] == exact
        for limit in (0, 1, 5, 20):
            cut = counts.cut(limit)
            assert exact[cut] <= limit and (cut == len(t) or exact[-1] > limit or exact[cut] == limit)


@pytest.mark.parametrize("clash", [False, True])
def test_token_counts(spark, clash):
    docs, theirs = frame(spark, clash=clash), Tokenizer.from_file(BYTES)
    n = lambda t: len(theirs.encode(t or "", add_special_tokens=False).ids)
    want = [(r["doc_id"], len((r["text"] or "").encode()), n(r["text"]), n(r["text"]) > 100) for r in docs.collect()]
    assert rows(token_count.token_counts(docs, BYTES, 100), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_count.token_counts(empty(spark), BYTES).count() == 0
    assert all(n(r["text"]) <= 7 for r in token_count.truncate(docs, BYTES, 7).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "sentencepiece"]
    passage = prose(1, 90)
    spread = [(k, prose(100 + k, 40), "en" if k % 2 else "de", "s") for k in range(40)]
    docs = frame(spark, spread + [(200, None, "en", "s"), (201, "123", "en", "s"), (202, spread[3][1], "en", "s"), (203, spread[5][1] + " tail", "en", "s"), (204, f"{prose(7, 30)} {passage}", "en", "s")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(40)) - {3} | {202}
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got[7]["n_tokens"] == len(theirs.encode(spread[7][1])) + 2


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_equals_brute_force(spark, tmp_path, clash):
    """Nulls, empty and very long texts, ties, repeated rows, null ids, clashing columns: stage by stage in plain Python."""
    import corpus_pipeline
    import regex

    from sparkloom.llm import decontaminate

    from .test_dedup import brute_join

    items = [prose(1, 90), "If a box holds 3 red balls and 5 blue balls how many balls are there"]
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame(spark).collect()]
    base += [(300 + k, f"{prose(50 + k, 30)}. {items[k % 2].replace('3', '4')}. {prose(60 + k, 30)}", "en", "s") for k in range(4)] + [(400 + k, prose(500, 60) + f" {k}" * (k % 3), "de", "s") for k in range(6)]
    docs = frame(spark, base, clash)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    left = [(i, t) for i, t, *_ in base if t and regex.search(r"\p{L}", t)]
    best: dict = {}
    for i, t in left:
        best[t] = i if t not in best or (i is not None and (best[t] is None or i > best[t])) else best[t]
    left = [(i, t) for t, i in best.items()]
    component = {(i, n): c for i, n, c in brute_join(frame(spark, [(i, t, "", "") for i, t in left]))}
    keeps = {i for (i, _), c in component.items() if i is None or i == c}
    left = [(i, t) for i, t in left if i in keeps]
    bench = decontaminate.Bench([0, 1], items)
    left = [(i, t) for i, t in left if not ((f := decontaminate.examine(bench, [t])[0]) and f[4])]
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == sorted(((i, len(theirs.encode(t)) + 2) for i, t in left), key=str) and 10 < len(got) < len(base) - 8


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(1, 90))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in found) == 1 for n in range(1, 11)) and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert set(queries.queries()) == {q for q in found if q.startswith("op")}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_suffix_dedup", "op5_ngram_join"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    df = queries.queries()[name](spark, sf)
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        want = c.sql(queries.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_prefixes_of_texts_with_added_tokens():
    """Counts at every prefix as the library has them; cuts at the limit only."""
    ours, theirs = token_count.loaded(BYTES), Tokenizer.from_file(BYTES)
    n = lambda t: len(theirs.encode(t, add_special_tokens=False).ids)
    end = "<|endoftext|>"
    for t in (end, f"{end} two words", f"ab  {end}{end}  cd's {end}", f"one two{end}three <|endof {end[:-1]} four", f"x\n\n {end}\n y"):
        counts = ours.prefix_counts(t)
        assert [counts.at(e) for e in range(len(t) + 1)] == [n(t[:e]) for e in range(len(t) + 1)]
        for limit in range(12):
            kept = t[: counts.cut(limit)]
            assert n(kept) <= limit and (kept == t or limit < n(t))
    text = end + " word" * 50
    assert text[: ours.prefix_counts(text).cut(1024)] == text


def test_truncation_keeps_texts_with_added_tokens(spark):
    text = "<|endoftext|>" + " word" * 50
    docs = spark.createDataFrame([(1, text), (2, "a<|endoftext|>b"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in token_count.truncate(docs, BYTES, 1024).collect()}
    assert got == {1: text, 2: "a<|endoftext|>b", 3: ""}
    assert {r["doc_id"]: r["text"] for r in token_count.truncate(docs, BYTES, 3).collect()} == {1: "<|endoftext|> word word", 2: "a<|endoftext|>b", 3: ""}
