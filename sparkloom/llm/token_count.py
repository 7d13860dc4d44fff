"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies of the tokenizers library.

The text is cut as the vocabulary's pre-tokeniser does; each part's prefix table (token_tables.py) holds the count of
tokens at every prefix, and running sums over the parts hold it for the text. A prefix that ends inside a part differs
from the whole text's cut in its last two parts only, so its count needs those to be cut again, never a re-encoding.

Defined results: null text counts as empty and has 0 tokens; strings of added tokens inside a text count as that one
token, as the library does by default; ids pass through in any type; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_tables import MEMO, PrefixTable

#: Fixed value: the cut of byte-level pre-tokenisers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_names() -> dict[str, int]:
    """The printable characters by which such vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normaliser is supported")
        if spec["model"].get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("vocabularies that skip merges, or tokens that take in white space, are not supported")
        byte = byte_names()
        own = {t["content"] for t in spec["added_tokens"]}
        latin = lambda s: "".join(chr(byte[c]) for c in s)
        ids = spec["model"]["vocab"]
        surface = {i: latin(s) for s, i in ids.items() if s not in own}
        ranks = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[ids[a], ids[b]] = (k, ids[a + b])
        self.table = PrefixTable(surface, lambda a, b: ranks.get((a, b)))
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(own, key=len, reverse=True))) if own else None
        self.part = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def part_count(self, part: str) -> int:
        n = self.memo.get(part)
        if n is None:
            n = self.table.table(part.encode().decode("latin-1"))[1][-1]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(part) <= 64:
                self.memo[part] = n
        return n

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self.count, pieces))
        parts = self.part.findall(text)
        found = list(map(self.memo.get, parts))
        if None in found:
            found = [self.part_count(p) if f is None else f for p, f in zip(parts, found)]
        return sum(found)

    def prefix_counts(self, text: str) -> PrefixCounts:
        return PrefixCounts(self, text)


class PrefixCounts:
    """Token counts of the prefixes of one text. The string of an added token is one part and one token."""

    def __init__(self, model: ByteBpe, text: str):
        self.model, self.text = model, text
        self.starts, self.sums, self.added, at = [0], [0], set(), 0
        for found in [*(model.special.finditer(text) if model.special is not None else ()), None]:
            # Parts are cut between added tokens, as count() does.
            for part in model.part.findall(text[at : found.start()] if found else text[at:]):
                self.starts.append(self.starts[-1] + len(part))
                self.sums.append(self.sums[-1] + model.part_count(part))
            if found:
                at = found.end()
                self.added.add(len(self.starts) - 1)
                self.starts.append(at)
                self.sums.append(self.sums[-1] + 1)

    def at(self, end: int) -> int:
        """Tokens of text[:end], encoded by itself."""
        from bisect import bisect_left

        whole = max(0, bisect_left(self.starts, end) - 2)  # parts that are surely cut alike
        return self.sums[whole] + self.model.count(self.text[self.starts[whole] : end])

    def cut(self, limit: int) -> int:
        """The longest prefix that ends with a part or inside the part that goes over the limit, and keeps to it. An added
        token's string is kept whole or not at all."""
        from bisect import bisect_right

        k = bisect_right(self.sums, limit) - 1
        ends = range(self.starts[k], self.starts[k + 1]) if k + 1 < len(self.starts) and k not in self.added else [self.starts[k]]
        return max((e for e in ends if self.at(e) <= limit), default=self.starts[k])


@cache
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            counts = [model.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def truncate(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the longest beginning of the text, by PrefixCounts.cut(), that has at most limit tokens. Null text counts as
    empty; repeated rows give equal texts; doc_id may be null; an empty table gives no rows; other columns are ignored."""

    def run(batches):
        model = loaded(path)
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                out.append(text[: model.prefix_counts(text).cut(limit)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string")
