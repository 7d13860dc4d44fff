"""Fixtures that all operators of the subpackage must stand: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

WORDS = "the cat sat on a mat while seven dogs ran far over green hills and small birds sang loud songs near old stone walls".split()
#: Names that operators use inside.
CLASH = "id blk digest n h label score kept bucket code host path evidence _id __kept_id lang_pred"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(90)) if rng.random() < 0.2 else "") for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 90)
    words = base.split()
    near = " ".join(words[:40] + ["CHANGED"] + words[41:])
    return [None, "", " \t\n", "...!?", "one", "Two words", "three little words", base, base, base + " ", near, near.upper(), base[:300], prose(2, 120), prose(3, 5000), "é" * 900, "ab" * 700, "ünï cödé ▁ 日本語 🙂 \x00 end", prose(2, 120) + "\n" + base, "x" * 400, "x" * 401]


def frame(spark, rows=None, clash: bool = False):
    """doc_id, text, lang, source, n_chars; and, with clash, columns named as the operators' own."""
    if rows is None:
        rows = [(k, t, ("en", "de", None)[k % 3], f"s{k % 2}") for k, t in enumerate(texts())]
        rows += [rows[7], rows[7], (None, prose(9, 50), None, None), (None, None, "en", None)]
    df = spark.createDataFrame([(i, t, la, so, None if t is None else len(t)) for i, t, la, so in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(7).alias(c) for c in CLASH.split()))
    return df


def empty(spark):
    return frame(spark, []).limit(0)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
