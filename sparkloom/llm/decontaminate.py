"""Benchmark decontamination by template windows.

Words become canonical: numbers (with their separators), units after a number, and names (capitalised words side by side
inside a sentence) turn into typed placeholders; other words are lower-cased (A-Z). Capitalised words that open a
sentence are read both as ordinary words and as names. Windows of WINDOW canonical words are looked up in a hash table of the
benchmark's windows. Where a window has placeholders, the values that stand in its slots must fit together over the
match: one item value, one document value (two item values may become the same). Each passage of a text is tried as a
re-filling of its own. So a question with other numbers or names is
found, and a text that only has the same words around unrelated slots is not. Windows of plain words (no placeholders)
are looked up too, for copies whose case was changed.

A document is contaminated by an item if it holds at least SIMILARITY of the item's windows (either kind), or RUN plain
words of it in a row. A text of fewer plain words than a window is one window, all its words: a short item is found where
it is the whole document.

Data flow. The benchmark's windows are a table of (reading, hash, item, place, slots). A bit map of their hashes, of at most
2^MAP_BITS bits whatever the benchmark's size, travels with the one pass over the documents and lets through the windows that
may be there. These are joined with the table by hash: by broadcast while it has at most ``small`` rows, counted first,
else shuffled. A window that very many items share makes no pairs: only an item's rarest windows, one of which a contaminated
text must hold, name pairs of a text and an item (keyed()); then the other windows of these pairs are looked up. Hits are grouped by (text, item), where slots are
checked, and by text. A verdict depends on the text alone, so texts are told apart by a 128-bit digest, copies are
judged once, and every row keeps its own verdict at any benchmark size. Texts themselves are never shuffled.

Defined results: null texts count as empty and are clean, and null items are left out. Template windows with fewer than three
ordinary words are left out; the plain windows have them. Of equal items the first in order of id and text counts. Null ids are
allowed; an empty table of either kind gives clean documents or none. Repeated rows get equal results; other columns are
carried or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import LOWER, SIGNS, SPACE, U64, Rolling, checkpointed, frugal, keep_memory, mix, pieces, text_bytes

WINDOW, SIMILARITY, RUN, ORDINARY, SMALL, MAP_BITS = 5, 0.8, 13, 3, 500_000, 30
#: Words that count as units after a number.
UNITS = "% mm cm m km in inch inches ft feet foot mile miles yards mg g kg gram grams lb lbs pound pounds oz ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz w kw v usd eur dollar dollars euro euros cent cents percent degrees".split()
#: Titles that a dot may follow before a name.
TITLES = "mr mrs ms mx dr prof st rev sr sra srta hr fr mme mlle".split()
WORD, NUMBER, UNIT, NAME = range(4)
#: Readings of a text, see Canonical.
TEMPLATES, PLAIN = (0, 1), 2
PLACEHOLDER = mix(np.arange(4, dtype=np.uint64) + U64(77))
_KEYS = mix(np.arange(WINDOW, dtype=np.uint64) + U64(990)) | U64(1)
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    return Rolling(data).of(starts, ends)


_UNIT_HASHES, _TITLE_HASHES = np.sort(_hash_of(UNITS)), np.sort(_hash_of(TITLES))


class Reading(NamedTuple):
    """One way to read the words of many texts: kinds and hashes of tokens, the first word of each, where each ends, and the texts' offsets in tokens."""

    kind: np.ndarray
    hash: np.ndarray
    lead: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def windows(self) -> np.ndarray:
        """Hash of the window at each token."""
        n = len(self.hash) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            x = self.hash[:n] * _KEYS[0]
            for k in range(1, WINDOW):
                x += self.hash[k : k + n] * _KEYS[k]
        return mix(x)

    def valid(self) -> np.ndarray:
        """Whether the window at each token lies in one text and has enough ordinary words."""
        n = max(0, len(self.hash) - WINDOW + 1)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        words = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        return (row[:n] == row[WINDOW - 1 :][:n]) & (words[WINDOW:][:n] - words[:n] >= ORDINARY)


class Canonical:
    """Words of many texts: where they stand, plain hashes, the texts' offsets in words, and three readings: templates,
    templates in which capitalised openers of sentences are names, and plain words (names and numbers are ordinary there)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        gap = SIGNS[data] & (data != 37)  # % is a unit
        head, tail = ~gap, ~gap
        percent = data == 37
        head[1:] &= gap[:-1] | percent[1:] | percent[:-1]
        tail[:-1] &= gap[1:] | percent[1:] | percent[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        head[edge] |= ~gap[edge]
        tail[edge - 1] |= ~gap[edge - 1]
        self.data, self.start, self.end = data, np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.rows = np.searchsorted(self.start, offsets)
        s, e = self.start, self.end
        self.plain = Rolling(LOWER[data]).of(s, e)
        digits, stops = self.counts(DIGIT[data]), self.counts(ENDS[data])
        kind = np.zeros(len(s), np.int8)
        first = np.zeros(len(s), bool)
        first[self.rows[:-1][self.rows[:-1] < len(s)]] = True
        before = np.concatenate([[0], e[:-1]])
        opens = first | (stops[s] > stops[before])
        second = data[np.minimum(s + 1, max(len(data) - 1, 0))]
        capital = (data[s] >= 65) & (data[s] <= 90) & (e > s + 1) & ((second >= 97) & (second <= 122) | (second >= 128))
        kind[capital & ~opens] = NAME
        kind[digits[e] > digits[s]] = NUMBER
        after = np.zeros(len(s), bool)
        after[1:] = kind[:-1] == NUMBER
        at = np.minimum(np.searchsorted(_UNIT_HASHES, self.plain), len(_UNIT_HASHES) - 1)
        kind[after & ~first & (kind == WORD) & (_UNIT_HASHES[at] == self.plain)] = UNIT
        self.readings = (self.tokens(kind), self.tokens(np.where(capital & opens & (kind == WORD), NAME, kind).astype(np.int8)), Reading(np.zeros(len(s), np.int8), self.plain, np.arange(len(s)), e, self.rows))

    def tokens(self, kind: np.ndarray) -> Reading:
        """Words as canonical tokens: a number with its separators is one, and so are names side by side."""
        s, e, n = self.start, self.end, len(self.start)
        joined = np.zeros(n, bool)
        if n > 1:
            gap, left, right = s[1:] - e[:-1], kind[:-1], kind[1:]
            dots, blanks = self.counts(np.isin(self.data, (44, 46))), self.counts(SPACE[self.data])
            number = (left == NUMBER) & (right == NUMBER) & (gap == 1) & (dots[s[1:]] > dots[e[:-1]]) & DIGIT[self.data[e[:-1] - 1]] & DIGIT[self.data[s[1:]]]
            # Between names: blanks, or after a title a dot and blanks.
            dot = (self.data[np.minimum(e[:-1], len(self.data) - 1)] == 46) & np.isin(self.plain[:-1], _TITLE_HASHES)
            name = (left == NAME) & (right == NAME) & (blanks[s[1:]] - blanks[e[:-1]] == gap - dot)
            joined[1:] = number | name
            starts = self.rows[(self.rows > 0) & (self.rows < n)]
            joined[starts] = False
        lead = np.flatnonzero(~joined)
        kind = kind[lead]
        last = np.append(lead[1:], n)[: len(lead)] - 1
        return Reading(kind, np.where(kind == WORD, self.plain[lead], PLACEHOLDER[kind]), lead, e[last], np.searchsorted(lead, self.rows))

    def value(self, reading: int, k: int) -> bytes:
        r = self.readings[reading]
        return b" ".join(LOWER[self.data[self.start[r.lead[k]] : r.end[k]]].tobytes().split())

    @staticmethod
    def counts(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=out[1:], dtype=np.int32)
        return out


#: Reading, place in the text, place in the item, values in the slots of either, and the readings (as bits) that have a window of the item there.
Hits = list[tuple[int, int, int, bytes, bytes, int]]


def candidates(c: Canonical, kind: int, ordinary: bool = False):
    """Windows of one reading: their first tokens, rows and hashes. A text of fewer plain words than a window is one window."""
    r = c.readings[kind]
    x = r.windows()
    row = np.repeat(np.arange(len(r.rows) - 1), np.diff(r.rows))
    at = np.flatnonzero(r.valid() if ordinary else row[: len(x)] == row[WINDOW - 1 :][: len(x)])
    hashes, rows = x[at], row[at]
    if kind == PLAIN:
        few = np.flatnonzero((np.diff(r.rows) > 0) & (np.diff(r.rows) < WINDOW))
        if len(few):
            whole = np.zeros(len(few), np.uint64)
            for k in range(WINDOW - 1):
                has = np.flatnonzero(np.diff(r.rows)[few] > k)
                whole[has] = mix(whole[has] + r.hash[r.rows[few[has]] + k] + U64(k + 1))
            at, rows, hashes = np.concatenate([at, r.rows[few]]), np.concatenate([rows, few]), np.concatenate([hashes, whole])
    return at, rows, hashes


def slots(c: Canonical, kind: int, k: int, kinds: bool) -> bytes:
    """What stands in the window's slots, one field a token; kinds: each after its type."""
    r = c.readings[kind]
    if kind == PLAIN or not r.kind[k : k + WINDOW].any():
        return b""
    return b"\0".join(b"" if r.kind[j] == WORD else (bytes([r.kind[j]]) if kinds else b"") + c.value(kind, j) for j in range(k, k + WINDOW))


def filled(item: bytes, text: bytes) -> frozenset[tuple[bytes, bytes]]:
    """Pairs of an item's slot value, with its type, and the text's."""
    return frozenset((x, y) for x, y in zip(item.split(b"\0"), text.split(b"\0")) if x) if item else frozenset()


def longest(found: set[tuple[int, int]], n_words: int) -> int:
    """Words of the longest run: windows at p, p + 1, ... that match q, q + 1, ..."""
    most = 0
    for p, q in found:
        if (p - 1, q - 1) not in found:
            run = 1
            while (p + run, q + run) in found:
                run += 1
            most = max(most, run)
    return min(most + WINDOW - 1, n_words) if most else 0


def judge(found: Hits, n: tuple[int, int, int], n_words: int) -> tuple[float, bool, int]:
    """For one text and one item, which has n windows of each reading: similarity, whether slots were re-filled, longest run."""
    plain = {(p, q) for kind, p, q, *_ in found if kind == PLAIN}
    near = (len({q for _, q in plain}) / n[PLAIN] if plain else 0.0, False)
    run = longest(plain, n_words)
    template = [hit for hit in found if hit[0] != PLAIN]
    if template:
        good, refilled = consistent([(p, q, filled(mine, yours)) for _, p, q, mine, yours, _ in template])
        there = {q: has for _, _, q, _, _, has in template}
        most = max(sum(there[q] >> kind & 1 for q in good.tolist()) / n[kind] if n[kind] else 0.0 for kind in TEMPLATES)
        if most > near[0]:
            near = (most, refilled)
    return (*near, run)


def item_windows(c: Canonical):
    """The windows of items: (item, reading, hash, first word's place among all words, slots, readings that have one there)."""
    found, has = [], defaultdict(int)
    for kind in range(3):
        at, row, x = candidates(c, kind, True)
        for k, r, h in zip(at.tolist(), row.tolist(), x.view(np.int64).tolist()):
            q = int(c.readings[kind].lead[k])
            found.append((r, kind, h, q, slots(c, kind, k, True)))
            has[q] |= 1 << kind
    for r, kind, h, q, mine in found:
        yield r, kind, h, q, mine, has[q]


def consistent(found: list[tuple[int, int, frozenset]]) -> tuple[np.ndarray, bool]:
    """The item's windows (their first words) under the best re-filling that the text holds, and whether it differs
    from the item. found: (first word in the text, first word in the item, pairs of slot values).

    A re-filling gives each item value one document value. Each passage (hits of one alignment p - q, alone and with
    those up to WINDOW away, where words were put in or left out) votes for one; slots it does not know are settled by
    the hits elsewhere that agree with it. The votes of the whole text are one more candidate."""
    number, aligned = {}, defaultdict(set)
    for p, q, pairs in found:
        aligned[p - q].add(number.setdefault((q, pairs), len(number)))
    pairs = sorted({x for _, slots_ in number for x in slots_})
    if not pairs:
        return np.unique([q for q, _ in number]), False
    of_pair, of_slot = {x: k for k, x in enumerate(pairs)}, {x: k for k, x in enumerate(sorted({left for left, _ in pairs}))}
    # The last slot and its one pair stand for no slot.
    slot = np.array([of_slot[left] for left, _ in pairs] + [len(of_slot)])
    held = np.full((len(number), WINDOW), len(pairs))
    for k, (_, slots_) in enumerate(number):
        held[k, : len(slots_)] = [of_pair[x] for x in slots_]
    window = np.array([q for q, _ in number])

    def vote(hits, there: np.ndarray) -> None:
        votes = np.bincount(held[hits].ravel(), minlength=len(slot))
        order = np.lexsort((-votes, slot))
        order = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])]
        order = order[(votes[order] > 0) & (there[slot[order]] < 0)]
        there[slot[order]] = order

    edges, seeds = sorted(aligned), {()}
    for k, d in enumerate(edges):
        near = set()
        for step, j in ((1, k), (-1, k - 1)):
            while 0 <= j < len(edges) and abs(edges[j] - d) <= WINDOW:
                near |= aligned[edges[j]]
                j += step
        seeds |= {tuple(sorted(aligned[d])), tuple(sorted(near))}
    most, best, tried = len(set(window.tolist())), None, set()
    for seed in sorted(seeds, key=lambda x: (-len(x), x)):
        there = np.full(len(of_slot) + 1, -1)
        there[-1] = len(pairs)
        vote(list(seed), there)
        if there.tobytes() in tried:
            continue
        tried.add(there.tobytes())
        told = there[slot[held]]
        fits = np.flatnonzero(((told < 0) | (told == held)).all(1))
        if best is not None and len(np.unique(window[fits])) <= len(best[0]):
            continue
        vote(fits, there)
        fits = fits[(there[slot[held[fits]]] == held[fits]).all(1)]
        good = np.unique(window[fits])
        if best is None or len(good) > len(best[0]):
            best = (good, fits)
        if len(good) == most:
            break
    return best[0], any(pairs[x][0][1:] != pairs[x][1] for x in np.unique(held[best[1]]).tolist() if x < len(pairs))


class Bench:
    """A few items in memory, for single texts: what contamination() says of tables."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        self.ids, c = ids, Canonical(data, offsets)
        self.table, self.n, self.n_words = defaultdict(list), np.zeros((len(ids), 3), np.int64), np.diff(c.rows)
        for r, kind, h, q, mine, has in item_windows(c):
            self.table[kind, h].append((r, q, mine, has))
            self.n[r, kind] += 1


def examine(bench: Bench, text: pa.Array | pa.ChunkedArray, similarity: float = SIMILARITY, run: int = RUN) -> list[tuple | None]:
    """For each text, (item number, similarity, run, re-filled, contaminated, item number of the run), or None: the greatest
    similarity and the longest run, each over all items; of equals, the first item."""
    out: list[tuple | None] = []
    for one in pa.array(text).to_pylist():
        data, offsets = text_bytes(pa.array([one], pa.string()))
        c, pairs = Canonical(data, offsets), defaultdict(list)
        for kind in range(3):
            at, _, x = candidates(c, kind)
            for k, h in zip(at.tolist(), x.view(np.int64).tolist()):
                for item, q, mine, has in bench.table.get((kind, h), ()):
                    pairs[item].append((kind, int(c.readings[kind].lead[k]), q, mine, slots(c, kind, k, False), has))
        near, far = (0.0, 0, False), (0, 0)
        for item in sorted(pairs):
            share, refilled, words = judge(pairs[item], tuple(bench.n[item].tolist()), int(bench.n_words[item]))
            near, far = max(near, (share, -item, refilled), key=lambda x: x[:2]), max(far, (words, -item))
        out.append((-near[1] if near[0] else None, near[0], far[0], near[2], near[0] >= similarity or far[0] >= run, -far[1] if far[0] else None) if near[0] or far[0] else None)
    return out


def benchmark_tables(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The items (item, item_id, n_words, windows of each reading) and their windows (kind, hash, item, q, mine, has), both written
    once. item numbers the items in order of id and text."""
    texts = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    texts = checkpointed(texts.orderBy("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    window = pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("q", pa.int32()), ("mine", pa.binary()), ("has", pa.int32())])

    def run(batches):
        for batch in batches:
            for first, last in pieces(text_bytes(batch.column(1))[1], 500_000):
                part = batch.slice(first, last - first)
                c = Canonical(*text_bytes(part.column(1)))
                found, n = [[] for _ in range(len(part))], np.zeros((len(part), 3), np.int64)
                for r, kind, h, q, mine, has in item_windows(c):
                    found[r].append({"kind": kind, "hash": h, "q": q - int(c.rows[r]), "mine": mine, "has": has})
                    n[r, kind] += 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(c.rows), pa.int32()), *(pa.array(n[:, k], pa.int32()) for k in range(3)), pa.array(found, pa.list_(window))], ["item", "n_words", "n0", "n1", "n2", "windows"])

    made = checkpointed(texts.select("item", "text").mapInArrow(frugal(run), "item long, n_words int, n0 int, n1 int, n2 int, windows array<struct<kind: int, hash: bigint, q: int, mine: binary, has: int>>"))
    items = texts.select("item", "item_id").join(made.drop("windows"), "item")
    return items, checkpointed(made.select("item", F.explode("windows").alias("w")).select("w.kind", "w.hash", "item", "w.q", "w.mine", "w.has"))


def keyed(windows: DataFrame, similarity: float, run: int) -> DataFrame:
    """windows with `key`: whether a text that is contaminated by the item must hold one of those that have it. Of n windows of one
    reading, a share s can only be held if one of any n - ceil(s n) + 1 is: the rarest in the benchmark are taken. And `run` words
    in a row hold one of every (run - WINDOW + 1) plain windows: the rarest such choice is taken."""
    by_item, step = Window.partitionBy("item"), max(1, run - WINDOW + 1)
    often = windows.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("f"))
    w = windows.join(often, ["kind", "hash"]).select("item", "kind", "q", "f")

    def rarest(rows: DataFrame) -> DataFrame:
        """The (item, q) of rows (item, q, f) that must be met for the share."""
        n = F.count(F.lit(1)).over(by_item)
        ranked = rows.select("item", "q", F.row_number().over(by_item.orderBy("f", "q")).alias("nth"), n.alias("n"))
        return ranked.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).select("item", "q")

    # A template window counts under either reading of its first word.
    at = w.where(F.col("kind") != PLAIN).groupBy("item", "q").agg(F.sum("f").alias("f"), F.bool_or(F.col("kind") == 0).alias("k0"), F.bool_or(F.col("kind") == 1).alias("k1"))
    chosen = rarest(at.where("k0")).unionByName(rarest(at.where("k1"))).withColumn("plain", F.lit(False))
    plain = w.where(F.col("kind") == PLAIN)
    classes = plain.groupBy("item", (F.col("q") % step).alias("r")).agg(F.sum("f").alias("f")).groupBy("item").agg(F.min_by("r", F.struct("f", "r")).alias("r"), F.count(F.lit(1)).alias("n"))
    steps = plain.join(classes.where(F.col("n") == step), "item").where(F.col("q") % step == F.col("r")).select("item", "q")
    chosen = chosen.unionByName(rarest(plain).unionByName(steps).withColumn("plain", F.lit(True))).distinct()
    chosen = chosen.select(F.col("item").alias("_item"), F.col("q").alias("_q"), "plain")
    on = (F.col("item") == F.col("_item")) & (F.col("q") == F.col("_q")) & ((F.col("kind") == PLAIN) == F.col("plain"))
    return windows.join(chosen, on, "left").select(*windows.columns, F.col("_q").isNotNull().alias("key"))


def bit_map(windows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Which leading bits the hashes have: 4,096 bits a window, 2^20 at least and 2^MAP_BITS at most."""
    bits = min(MAP_BITS, max(20, int(4096 * n - 1).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    part = windows.select(F.floor(place / 32768).alias("k"), (place % 32768).alias("bit")).distinct().groupBy("k").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in part.toLocalIterator():
        out[r["k"] * 4096 : r["k"] * 4096 + 4096] = np.frombuffer(r["map"], np.uint8)
    return bits, out


def suspects(text: pa.Array | pa.ChunkedArray, bits: int, there: np.ndarray):
    """Some texts at a time: (first, last, canonical texts, [(reading, tokens, rows, hashes)] of the windows that may be an item's)."""
    keep_memory()
    data, offsets = text_bytes(text)
    for first, last in pieces(offsets, 500_000):
        c = Canonical(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        found = []
        for kind in range(3):
            at, row, x = candidates(c, kind)
            place = x >> U64(64 - bits)
            hit = np.flatnonzero(there[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1)
            found.append((kind, at[hit], row[hit], x[hit].view(np.int64)))
        yield first, last, c, found


def digest_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def verdicts(found: DataFrame, items: DataFrame, windows: DataFrame, n: int, similarity: float, run: int, small: int) -> DataFrame:
    """(digest, contaminated, item_id, similarity, run_words, refilled, run_item_id) of the texts that hold a window of an item.
    found: (digest, hits) of suspects."""
    sized = (lambda d: F.broadcast(d)) if n <= small else (lambda d: d)
    hits = checkpointed(found.dropDuplicates(["digest"]).select("digest", F.explode("hits").alias("h")).select("digest", "h.kind", "h.hash", "h.p", "h.yours"))
    # First the pairs of a text and an item that may be one, by the item's rarest windows; then all windows of these pairs.
    pairs = hits.select("digest", "kind", "hash").join(sized(windows.where("key").select("kind", "hash", "item")), ["kind", "hash"]).select("digest", "item").distinct()
    hits = checkpointed(pairs).join(hits, "digest").join(sized(windows.drop("key")), ["item", "kind", "hash"]).select("digest", "item", "kind", "p", "q", "mine", "yours", "has")
    hits = checkpointed(hits)
    bins = max(8, hits.count() // 20_000)

    def settle(table: pa.Table) -> pa.Table:
        pairs, about = defaultdict(list), {}
        columns = [table.column(c).to_pylist() for c in ("digest", "item", "kind", "p", "q", "mine", "yours", "has")]
        for digest, item, *hit in zip(*columns):
            pairs[digest, item].append(hit)
        items_, first = np.unique(table.column("item").to_numpy(), return_index=True)
        for item, n_words, *n in zip(items_.tolist(), *(table.column(c).to_numpy()[first].tolist() for c in ("n_words", "n0", "n1", "n2"))):
            about[item] = (tuple(n), n_words)
        out = [(digest, item, *judge(hit, *about[item])) for (digest, item), hit in pairs.items()]
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_JUDGED)], schema=_JUDGED)

    about = items.drop("item_id")
    hits = hits.join(sized(about), "item").withColumn("bin", F.pmod(F.xxhash64("digest", "item"), F.lit(bins)))
    judged = hits.groupBy("bin").applyInArrow(frugal(settle), "digest binary, item long, similarity double, refilled boolean, run_words int")
    near = F.max_by(F.struct("similarity", "refilled", F.col("item").alias("near_item")), F.struct("similarity", -F.col("item"))).alias("near")
    far = F.max_by(F.struct("run_words", F.col("item").alias("far_item")), F.struct("run_words", -F.col("item"))).alias("far")
    best = judged.groupBy("digest").agg(near, far).select("digest", "near.*", "far.*")
    ids = items.select(F.col("item").alias("_item"), "item_id")
    for item, name in (("near_item", "item_id"), ("far_item", "run_item_id")):
        best = best.join(sized(ids.select("_item", F.col("item_id").alias(name))), F.col(item) == F.col("_item")).drop("_item")
    sure, ran = F.col("similarity") > 0, F.col("run_words") > 0
    return best.select("digest", ((F.col("similarity") >= similarity) | (F.col("run_words") >= run)).alias("contaminated"), F.when(sure, F.col("item_id")).alias("item_id"), "similarity", "run_words", "refilled", F.when(ran, F.col("run_item_id")).alias("run_item_id"))


_HIT = pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("p", pa.int32()), ("yours", pa.binary())])
_JUDGED = pa.schema([("digest", pa.binary()), ("item", pa.int64()), ("similarity", pa.float64()), ("refilled", pa.bool_()), ("run_words", pa.int32())])


def looked_up(docs: DataFrame, benchmark: DataFrame, id_: F.Column, text_col: str, item_col: str, item_text_col: str, similarity: float, run: int, small: int):
    """(doc_id, digest) of each row, the digest null where no window may be an item's; the verdicts; the bit map."""
    items, windows = benchmark_tables(benchmark, item_col, item_text_col)
    windows = checkpointed(keyed(windows, similarity, run))
    n = windows.count()
    bits, there = bit_map(windows, n)
    sent = docs.sparkSession.sparkContext.broadcast((bits, there))

    def look(batches):
        for batch in batches:
            for first, last, c, found in suspects(batch.column(1), *sent.value):
                part = batch.slice(first, last - first)
                kind, row, x, p = ([] for _ in range(4))
                yours = []
                for k, at, rows_, hashes in found:
                    kind.append(np.full(len(at), k, np.int32))
                    row.append(rows_)
                    x.append(hashes)
                    p.append((c.readings[k].lead[at] - c.rows[rows_]).astype(np.int32))
                    yours += [slots(c, k, j, False) for j in at.tolist()]
                kind, row, x, p = map(np.concatenate, (kind, row, x, p))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(last - first + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(x[order]), pa.array(p[order]), pa.array([yours[j] for j in order.tolist()], pa.binary())], fields=list(_HIT))
                digests = [digest_of(t.as_py()) if more else None for t, more in zip(part.column(1), np.diff(ends).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), hits)], ["doc_id", "digest", "hits"])

    rows = docs.select(id_.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(rows.mapInArrow(frugal(look), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, hits array<struct<kind: int, hash: bigint, p: int, yours: binary>>"))
    found = verdicts(rows.where("digest is not null").select("digest", "hits"), items, windows, n, similarity, run, small)
    return rows.select("doc_id", "digest"), checkpointed(found), sent


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, run: int = RUN, small: int = SMALL) -> DataFrame:
    """Per row of docs: doc_id, contaminated, item_id (of the greatest similarity, or null), similarity, run_words (the longest
    run of any item), refilled, run_item_id (the item of that run, or null). Items of which the text holds too little to be
    contaminated need not be looked at: a clean text may have 0 and nulls there."""
    rows, found, _ = looked_up(docs, benchmark, F.col(id_col), text_col, item_col, item_text_col, similarity, run, small)
    found = found.withColumnRenamed("digest", "_digest")
    judged = rows.where("digest is not null").join(found, F.col("digest") == F.col("_digest"), "left")
    nothing = {"contaminated": False, "similarity": 0.0, "run_words": 0, "refilled": False}
    columns = ["doc_id", "contaminated", "item_id", "similarity", "run_words", "refilled", "run_item_id"]
    judged = judged.select(*(F.coalesce(c, F.lit(nothing[c])).alias(c) if c in nothing else F.col(c) for c in columns))
    item_type = benchmark.schema[item_col].dataType
    calm = rows.where("digest is null").select(*(F.col(c) if c == "doc_id" else F.lit(nothing.get(c)).cast(item_type if c not in nothing else judged.schema[c].dataType).alias(c) for c in columns))
    return calm.unionByName(judged)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, run: int = RUN, small: int = SMALL) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns. Rows without a suspect window are never shuffled."""
    _, found, sent = looked_up(docs, benchmark, F.lit(0), text_col, item_col, item_text_col, similarity, run, small)
    bad = found.where("contaminated").select(F.col("digest").alias("__bad_digest"))
    at = docs.columns.index(text_col)

    def mark(batches):
        for batch in batches:
            digests = [None] * len(batch)
            for first, _, _, hits in suspects(batch.column(at).cast(pa.string()), *sent.value):
                for r in np.unique(np.concatenate([row for _, _, row, _ in hits])).tolist():
                    digests[first + r] = digest_of(batch.column(at)[first + r].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "__digest"])

    schema = StructType([*docs.schema.fields, StructField("__digest", BinaryType())])
    marked = docs.mapInArrow(frugal(mark), schema)
    if bad.count() <= small:
        return marked.join(F.broadcast(bad), F.col("__digest") == F.col("__bad_digest"), "left_anti").drop("__digest")
    suspect = marked.where("__digest is not null").join(bad, F.col("__digest") == F.col("__bad_digest"), "left_anti")
    return marked.where("__digest is null").unionByName(suspect).drop("__digest")
