"""Removal of repeated 400-byte strings by suffixes, sorted one bucket at a time, with difference-cover ranks.

1. Sieve. Positions whose offset in their document lies in a difference cover modulo v are named by the 64-bit hash of their
   next bytes, and names are counted over the corpus (packed.py). For any two suffixes there is a shift below v that takes both
   into the sample, so a suffix none of whose samples repeats is settled: nothing equals it. A false match of names only
   keeps a suffix open. Open suffixes are about as many as bytes are repeated.
2. Buckets. Open suffixes side by side whose first bytes have the same least 32-byte string (by hash) travel as one stretch
   of text, a few bytes a suffix. Equal suffixes have equal least strings, so they meet in one bucket. Equal stretches
   (128-bit digests) are one row after a map-side aggregation, so a passage that a third of all rows hold is sorted once;
   all its suffixes are ties.
3. Sort. Each bucket of a few MB is sorted by itself: suffixes by their first 13 bytes, and those that tie by the ranks of the
   cover sample (modulo 13), which are computed before by doubling; then by the last bytes that the sample leaves over.
   Equal neighbours are ties to the full depth, compared by bytes and ranks of bytes, never by hashes. A least string whose
   stretches pass HOT_BYTES (one line in very many contexts) isn't sorted in one task: its suffixes are grouped by
   SHA-256 of their bytes, with partial sums on the map side.
4. Each document removes the bytes that its tied suffixes cover.

Copies of a whole document are found first (exact_dedup.py): all their bytes are repeated if they have the depth at least,
and one of them stands for all in the sort.

Defined results: null text counts as empty; texts shorter than the depth keep all; a string that repeats inside one document
counts; strings are judged on the input; cuts may fall inside a character, so what is kept is bytes. Repeated rows
are copies; null ids are allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import Rolling, bits_for, block_of, checkpointed, dealt_texts, distinct, keep_memory, let_go, text_bytes, text_size, unpacked
from .exact_dedup import exact_dedup

DEPTH, COVER_ORDER, PIECE, LEAST_BYTES = 400, 2, 1_000_000, 32
#: Text of a bucket that is aimed at, and text of one least string from which its suffixes are grouped by digest.
BUCKET_BYTES, HOT_BYTES = 1_000_000, 4_000_000
#: Most hot least strings whose hashes are broadcast.
SMALL = 500_000


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """v = 24r^2 + 36r + 13 and 6r + 4 residues whose differences are all residues modulo v (Colbourn and Ling)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


def cover_for(depth: int, order: int = COVER_ORDER) -> tuple[int, np.ndarray]:
    """The largest cover up to the order whose sampled strings have at least half the depth."""
    while order and 2 * difference_cover(order)[0] > depth:
        order -= 1
    v, d = difference_cover(order)
    return (v, d) if 2 * v <= depth else (1, np.zeros(1, np.int64))


def in_order(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys (from 0 to most) in sorted order, and whether each differs from the one before it. A place is sorted
    along in the low bits of its key where both have room: faster than to sort places by key."""
    n = len(keys)
    low = max(1, int(n).bit_length())
    if most.bit_length() + low <= 63:
        packed = np.sort(keys.astype(np.int64) << low | np.arange(n))
        order, keys = packed & ((1 << low) - 1), packed >> low
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.zeros(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, new


def dense(keys: np.ndarray, most: int = 1 << 64) -> np.ndarray:
    """Ranks of keys, from 0, equal for equal keys."""
    order, new = in_order(keys, most)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each pair of ranks, in the pairs' order, and a bound of it."""
    if not len(high):
        return high, 0
    bits = int(low.max()).bit_length()
    return high << bits | low, (int(high.max()) + 1 << bits) - 1


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return dense(*pairs(high, low))


#: The cover's period inside a bucket, its residues, and the number of each.
PERIOD, RESIDUES = difference_cover(0)
_NTH = np.full(PERIOD, -1)
_NTH[RESIDUES] = np.arange(len(RESIDUES))


class SuffixBucket:
    """The suffixes of one bucket: some texts, of each its first `count` suffixes."""

    def __init__(self, texts: list[bytes], counts: np.ndarray):
        size = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum(size) - size
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.nth = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = first[self.text] + self.nth
        self.left = size[self.text] - self.nth  # bytes of the suffix
        self.sampled: dict[int, np.ndarray] = {}

    def words(self) -> np.ndarray:
        """The 8 bytes from each place on as a number whose order is that of the bytes."""
        data = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.uint64)
        out = np.zeros(len(self.data), np.uint64)
        for k in range(8):
            out |= data[k : k + len(out)] << np.uint64(56 - 8 * k)
        return out

    def prefix_ranks(self, length: int) -> np.ndarray:
        """Rank of the `length` bytes from each place on. Those that pass the end of their text are never looked at."""
        words = self.words()
        if length < 8:
            return dense(words >> np.uint64(64 - 8 * length))
        eight, n = dense(words), len(words)
        out = eight
        for k in [*range(8, length - 7, 8), length - 8][: -(-length // 8) - 1]:
            out = joined(out, eight[np.minimum(np.arange(n) + k, n - 1)])
        return out

    def first_ranks(self) -> np.ndarray:
        """Rank of the first PERIOD bytes from each place on."""
        if not hasattr(self, "_first"):
            self._first = self.prefix_ranks(PERIOD)
        return self._first

    def sample_ranks(self, length: int) -> np.ndarray:
        """Rank of the `length` bytes (a multiple of PERIOD) from each place of the cover sample on, by doubling. The sample's
        places are numbered in order, so PERIOD bytes on is len(RESIDUES) numbers on."""
        if not self.sampled:
            at = np.arange(len(self.data))
            self.sampled[PERIOD] = self.first_ranks()[at[_NTH[at % PERIOD] >= 0]]
        have = PERIOD
        while have < length:
            step = min(have, length - have)
            if have + step not in self.sampled:
                ranks, jump = self.sampled[have], step // PERIOD * len(RESIDUES)
                out = np.zeros(len(ranks), np.int64)
                out[: max(0, len(ranks) - jump)] = joined(ranks[: max(0, len(ranks) - jump)], ranks[jump:])
                self.sampled[have + step] = out
            have += step
        return self.sampled[length]

    def ties(self, depth: int, among: np.ndarray | None = None) -> np.ndarray:
        """For each suffix (of those among, if given), whether another one has the same `depth` bytes."""
        tied = np.zeros(len(self.place), bool)
        use = np.flatnonzero(self.left >= depth if among is None else among & (self.left >= depth))
        if not len(use):
            return tied
        place = self.place[use]
        if depth < 3 * PERIOD:
            tied[use] = self.again(self.prefix_ranks(depth)[place], len(self.data))
            return tied
        # The first bytes and the last 2 * PERIOD; samples between them reach from below PERIOD to beyond depth - 2 * PERIOD.
        first = self.first_ranks()
        ends = joined(joined(first[place], first[place + depth - 2 * PERIOD]), first[place + depth - PERIOD])
        open_ = np.flatnonzero(self.again(ends, len(ends)))
        use, place, ends = use[open_], place[open_], ends[open_]
        ranks = self.sample_ranks((depth - PERIOD + 1) // PERIOD * PERIOD)
        for shift in range(PERIOD):
            whole, residue = np.divmod(place + shift, PERIOD)
            at = np.flatnonzero(_NTH[residue] >= 0)
            tied[use[at]] |= self.again(*pairs(ends[at], ranks[whole[at] * len(RESIDUES) + _NTH[residue[at]]]))
        return tied

    @staticmethod
    def again(keys: np.ndarray, most: int) -> np.ndarray:
        """Whether a key has an equal neighbour in sorted order."""
        order, new = in_order(keys, most)
        out = np.zeros(len(keys), bool)
        if len(keys) > 1:
            same = ~new[1:]
            out[order[1:][same]] = True
            out[order[:-1][same]] = True
        return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[k : k + width] at each k; beyond the end, of what there is."""
    n, most = len(x), np.iinfo(np.uint64).max
    whole = -(-(n + width) // width) * width
    padded = np.full(whole, most, np.uint64)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Text:
    """The texts of one block that take part, in pieces; long texts are cut into overlapping pieces."""

    def __init__(self, texts: list[bytes], depth: int, reach: int = 0):
        """depth: bytes that a suffix has at least; reach: bytes of a suffix that are looked at, if more."""
        self.depth, self.reach, self.pieces = depth, max(reach, depth), []
        now, size = [], 0
        for k, t in enumerate(texts):
            if len(t) < depth:
                continue
            for start in range(0, len(t) - depth + 1, PIECE):
                part = t[start : start + PIECE + self.reach - 1]
                now.append((k, start, part))
                size += len(part)
                if size >= PIECE:
                    self.pieces.append(now)
                    now, size = [], 0
        if now:
            self.pieces.append(now)

    def walk(self):
        """For each piece: hashes, text number and offset of every byte, and how many bytes of its part follow."""
        for parts in self.pieces:
            data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
            size = np.array([len(p) for _, _, p in parts])
            end = np.repeat(np.cumsum(size), size)
            place = np.arange(len(data))
            offset = place - np.repeat(np.cumsum(size) - size, size) + np.repeat([s for _, s, _ in parts], size)
            yield Rolling(data), np.repeat([k for k, _, _ in parts], size), offset, end - place

    def sample(self, v: int, cover: np.ndarray):
        """For each piece: places of the sample, and their names. Of overlapping pieces, both have the overlap's."""
        inside = np.zeros(v, bool)
        inside[cover % v] = True
        length = self.depth - v + 1
        for rolling, _, offset, left in self.walk():
            at = np.flatnonzero(inside[offset % v] & (left >= length))
            yield at, rolling.of(at, at + length)

    def stretches(self, v: int, found: list, again: np.ndarray):
        """Stretches of open suffixes with one least string: (text number, offset, suffixes, least string's hash, bytes).
        found, again: of sample(), and whether each name repeats."""
        short, first = max(1, min(LEAST_BYTES, self.depth // 2)), 0
        for parts, (at, _), (rolling, number, offset, left) in zip(self.pieces, found, self.walk()):
            raw = b"".join(p for _, _, p in parts)
            # Of overlapping parts, a suffix is the first one's to settle.
            mine = left > np.repeat([len(p) - PIECE for _, _, p in parts], [len(p) for _, _, p in parts])
            flags = np.zeros(len(left), np.int32)
            flags[at[again[first : first + len(at)]]] = 1
            first += len(at)
            sums = np.concatenate([[0], np.cumsum(flags)])
            place = np.flatnonzero(mine & (left >= self.depth))
            place = place[sums[place + v] > sums[place]]
            if not len(place):
                continue
            start = np.arange(max(0, len(raw) - short + 1))
            least = sliding_least(rolling.of(start, start + short), self.depth - short + 1)[place]
            head = np.ones(len(place), bool)
            head[1:] = (np.diff(place) != 1) | (number[place[1:]] != number[place[:-1]]) | (least[1:] != least[:-1])
            cut = np.append(np.flatnonzero(head), len(place))
            for a, b in zip(cut, cut[1:]):
                p, q = int(place[a]), int(place[b - 1])
                yield int(number[p]), int(offset[p]), int(b - a), int(least[a].view(np.int64)), raw[p : q + min(self.reach, int(left[q]))]


def dedup_substrings(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", order: int = COVER_ORDER, report: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with report (at most depth), also n_repeated: the bytes
    that strings of `report` bytes cover which start anywhere else, too. They stay unless strings of `depth` cover them."""
    return _run(docs, depth, id_col, text_col, order, report, keep=False)


def kept_text(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", order: int = COVER_ORDER) -> DataFrame:
    """The same, with the remaining bytes in a column `kept` (binary)."""
    return _run(docs, depth, id_col, text_col, order, None, keep=True)


def cover(size: int, starts: np.ndarray, depth: int) -> np.ndarray:
    """Which of `size` bytes strings of `depth` bytes cover."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth, -1)
    return np.cumsum(change)[:-1] > 0


STRETCH = pa.schema([("blk", pa.int32()), ("digest", pa.binary()), ("least", pa.int64()), ("suffixes", pa.int32()), ("text", pa.binary()), ("times", pa.int32()), ("places", pa.binary())])
TIES = pa.schema([("digest", pa.binary()), ("deep", pa.binary()), ("near", pa.binary())])


def _run(docs: DataFrame, depth: int, id_col: str, text_col: str, order: int, report: int | None, keep: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    if report is not None and not 0 < report <= depth:
        raise ValueError("report: from 1 to depth")
    id_type = docs.schema[id_col].dataType
    id_sql, id_arrow = id_type.simpleString(), to_arrow_type(id_type)
    near = report or depth
    v, cover_set = cover_for(near, order)
    _, n_bytes = text_size(docs, text_col)
    bits = bits_for(n_bytes * len(cover_set) / v)
    # Written in the partitions that all steps use: no step shuffles a text again.
    dealt = dealt_texts(docs, id_col, text_col, n_bytes)
    copies = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    side = "blk int, stage int, bucket int, code binary, id {}, digest string, stands boolean, places binary, suffixes int, size int, deep binary, near binary, all boolean".format(id_sql)
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in side.split(", ")}

    def as_side(rows: DataFrame, stage: int, *given: str) -> DataFrame:
        return rows.select(*(F.lit(stage).alias(c) if c == "stage" else F.col(c) if c in given else x.alias(c) for c, x in none.items()))

    info = as_side(copies.select(block_of("doc_id", n_bytes).alias("blk"), F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stands")), 0, "blk", "id", "digest", "stands")

    def local(table: pa.Table, more: pa.Table):
        """The block's texts in an order that every task finds again; of each, whether it has copies; and those that take part."""
        keep_memory()
        data, offsets = text_bytes(unpacked(table.column("text")))
        raw = data.tobytes()
        ids = table.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k], raw[offsets[k] : offsets[k + 1]]))
        ids, texts = [ids[k] for k in order], [raw[offsets[k] : offsets[k + 1]] for k in order]
        known: dict = {}
        for stage, id_, digest, stands in zip(*(more.column(c).to_pylist() for c in ("stage", "id", "digest", "stands"))):
            if stage == 0:
                known.setdefault(id_, {})[digest] = stands
        copied, part, seen = [False] * len(ids), [], set()
        for k, (id_, text) in enumerate(zip(ids, texts)):
            if id_ in known:
                digest = hashlib.sha256(text).hexdigest()
                if digest in known[id_]:
                    copied[k] = True
                    if not known[id_][digest] or (id_, digest) in seen:
                        continue
                    seen.add((id_, digest))
            part.append(k)
        return ids, texts, copied, part

    def names(text: Text):
        found = list(text.sample(v, cover_set))
        keys = np.concatenate([packed.short(h, bits) for _, h in found]) if found else np.zeros(0, np.uint64)
        return found, *distinct(keys, bits + 32)

    def taking_part(table: pa.Table, more: pa.Table) -> Text:
        _, texts, _, part = local(table, more)
        return Text([texts[k] for k in part], near, depth)

    def send_sample(table: pa.Table, more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed.messages(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, keys, _, times = names(taking_part(table, more))
        return packed.messages(table.column("blk")[0].as_py(), keys, times)

    def send_stretches(table: pa.Table, more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return STRETCH.empty_table()
        text = taking_part(table, more)
        found, _, inverse, _ = names(text)
        replies = more.take(pa.array(np.flatnonzero(more.column("stage").to_numpy() == 1), pa.int64()))
        again = packed.answers(replies)[inverse] > 0 if len(inverse) else np.zeros(0, bool)
        once: dict = {}
        for number, offset, suffixes, least, raw in text.stretches(v, found, again):
            digest = hashlib.blake2b(raw, digest_size=16, salt=suffixes.to_bytes(8, "little")).digest()
            once.setdefault(digest, (least, suffixes, raw, []))[3].append((number, offset))
        blk, rows = table.column("blk")[0].as_py(), list(once.items())
        columns = [[blk] * len(rows), [d for d, _ in rows], *([x[k] for _, x in rows] for k in range(3)), [len(x[3]) for _, x in rows], [np.array(x[3], np.int32).tobytes() for _, x in rows]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, STRETCH)], schema=STRETCH)

    def sort_bucket(table: pa.Table) -> pa.Table:
        keep_memory()
        texts, suffixes = [x.as_buffer().to_pybytes() for x in table.column("text")], table.column("suffixes").to_numpy()
        bucket = SuffixBucket(texts, suffixes)
        cut = np.cumsum(suffixes)[:-1]
        close = bucket.ties(near)
        deep = np.split(bucket.ties(depth, close) if near < depth else close, cut)
        close = np.split(close, cut)
        out = [(d, np.packbits(x).tobytes(), np.packbits(y).tobytes()) for d, n, x, y in zip(table.column("digest").to_pylist(), table.column("times").to_pylist(), deep, close) if n == 1 and y.any()]
        return pa.table([pa.array([r[k] for r in out], TIES.field(k).type) for k in range(3)], schema=TIES)

    fields = [("doc_id", id_arrow), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    out_schema = pa.schema(fields + [("n_repeated", pa.int64())] * (report is not None) + [("kept", pa.binary())] * keep)

    def finish(table: pa.Table, more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        ids, texts, copied, part = local(table, more)
        tied: dict = {}
        for r in more.take(pa.array(np.flatnonzero(more.column("stage").to_numpy() == 2), pa.int64())).select(["places", "suffixes", "size", "deep", "near", "all"]).to_pylist():
            nth = np.arange(r["suffixes"])
            flags = [np.ones(r["suffixes"], bool) if r["all"] else np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["suffixes"]).astype(bool) for c in ("deep", "near")]
            starts = [nth[f & (r["size"] - nth >= d)] for f, d in zip(flags, (depth, near))]
            for number, offset in np.frombuffer(r["places"], np.int32).reshape(-1, 2).tolist():
                for mine, s in zip(tied.setdefault(part[number], ([], [])), starts):
                    mine.append(s + offset)
        rows = []
        for k, t in enumerate(texts):
            deep, close = (np.concatenate(x) for x in tied.get(k, ([np.zeros(0, np.int64)],) * 2))
            gone = np.ones(len(t), bool) if copied[k] and len(t) >= depth else cover(len(t), deep, depth)
            again = np.ones(len(t), bool) if copied[k] and len(t) >= near else cover(len(t), close, near)
            rest = np.frombuffer(t, np.uint8)[~gone].tobytes() if gone.any() else t
            rows.append((ids[k], len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) and gone[0]), hashlib.sha256(rest).hexdigest(), *[int(again.sum())] * (report is not None), *[rest] * keep))
        return pa.table([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(out_schema)], schema=out_schema)

    grouped = dealt.groupBy("blk")
    replies = packed.count(grouped.cogroup(info.groupBy("blk")).applyInArrow(send_sample, packed.MESSAGE))
    more = info.unionByName(as_side(replies, 1, "blk", "bucket", "code"))
    sent = checkpointed(grouped.cogroup(more.groupBy("blk")).applyInArrow(send_stretches, "blk int, digest binary, least long, suffixes int, text binary, times int, places binary"))
    del replies, more
    let_go(docs.sparkSession)
    # Equal stretches are one row: a hot passage is a row a task before the shuffle.
    once = checkpointed(sent.groupBy("digest").agg(F.first("text").alias("text"), F.first("least").alias("least"), F.first("suffixes").alias("suffixes"), F.sum("times").cast("int").alias("times")))
    # Later steps need no stretch's text but these.
    sent = checkpointed(sent.select("blk", "digest", "places", "suffixes", F.octet_length("text").alias("size")))
    let_go(docs.sparkSession)
    by_least = once.groupBy("least").agg(F.sum(F.octet_length("text")).alias("size"))
    hot = F.col("size") > HOT_BYTES
    total = by_least.agg(F.sum(F.when(~hot, F.col("size"))), F.sum(F.when(hot, F.col("size"))), F.count_if(hot)).first()
    n_buckets, hot_parts = (-(-(x or 0) // BUCKET_BYTES) or 1 for x in total[:2])
    hot = by_least.where(hot).select("least")
    if total[2] <= SMALL:  # 8 bytes each
        hot = F.broadcast(hot)
    calm = once.join(hot, "least", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(n_buckets)))
    ties = calm.groupBy("bucket").applyInArrow(sort_bucket, "digest binary, deep binary, near binary")
    ties = ties.unionByName(_ties_of_hot(once.join(hot, "least", "left_semi"), depth, near, hot_parts))
    repeated = once.where("times > 1").select("digest", F.lit(None).cast("binary").alias("deep"), F.lit(None).cast("binary").alias("near"), F.lit(True).alias("all"))
    ties = checkpointed(ties.withColumn("all", F.lit(False)).unionByName(repeated))
    del once, by_least, hot, calm, repeated
    let_go(docs.sparkSession)
    found = sent.join(ties, "digest").drop("digest")
    more = info.unionByName(as_side(found, 2, "blk", "places", "suffixes", "size", "deep", "near", "all"))
    extra = ", n_repeated long" * (report is not None) + ", kept binary" * keep
    return grouped.cogroup(more.groupBy("blk")).applyInArrow(finish, f"doc_id {id_sql}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def _ties_of_hot(stretches: DataFrame, depth: int, near: int, parts: int) -> DataFrame:
    """(digest, deep, near) of stretches whose least string has too much text for one task: their suffixes, grouped by SHA-256."""
    one = stretches.select("digest", "times", "suffixes", "text", F.explode(F.sequence(F.lit(0), F.col("suffixes") - 1)).alias("nth"))
    one = one.select("digest", "times", "suffixes", "nth", *(F.when(F.octet_length("text") - F.col("nth") >= d, F.unhex(F.sha2(F.substring("text", F.col("nth") + 1, F.lit(d)), 256))).alias(c) for c, d in (("deep", depth), ("near", near))))
    for c in ("deep", "near"):
        often = one.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(c).alias("_name"))
        one = one.join(often, F.col(c) == F.col("_name"), "left").withColumn(c, F.col("_name").isNotNull()).drop("_name")

    def pack(table: pa.Table) -> pa.Table:
        digests, at = np.unique(np.array([x.hex() for x in table.column("digest").to_pylist()]), return_inverse=True)
        nth = table.column("nth").to_numpy()
        size = np.zeros(len(digests), np.int64)
        size[at] = table.column("suffixes").to_numpy()
        out = []
        for c in ("deep", "near"):
            bits = [np.zeros(s, np.uint8) for s in size]
            for d, k in zip(at[table.column(c).to_numpy(zero_copy_only=False)], nth[table.column(c).to_numpy(zero_copy_only=False)]):
                bits[d][k] = 1
            out.append([np.packbits(b).tobytes() for b in bits])
        return pa.table([pa.array([bytes.fromhex(d) for d in digests], pa.binary()), *(pa.array(x, pa.binary()) for x in out)], schema=TIES)

    bin_ = F.pmod(F.xxhash64("digest"), F.lit(parts))
    return one.where("times = 1 and near").withColumn("_bin", bin_).groupBy("_bin").applyInArrow(pack, "digest binary, deep binary, near binary")


#: The registered query (depth = 400, report = 300) by counting every string.
ORACLE = r"""
with t as (select doc_id, encode(coalesce(text, '')) as b from documents),
pos as (select doc_id, unnest(range(1, octet_length(b) - 298)) as i from t),
h as (select a.doc_id, i, md5(array_slice(b, i, i + 299)) as near, case when i + 399 <= octet_length(b) then md5(array_slice(b, i, i + 399)) end as deep from pos a join t using (doc_id)),
deep as (select doc_id, i from h where deep in (select deep from h where deep is not null group by 1 having count(*) > 1)),
near as (select doc_id, i from h where near in (select near from h group by 1 having count(*) > 1)),
runs as (
    select kind, doc_id, s, min(i) as a, max(i) + max(size) - 1 as z from (
        select *, sum(new) over (partition by kind, doc_id order by i rows unbounded preceding) as s from (
            select *, case when i <= lag(i) over (partition by kind, doc_id order by i) + size then 0 else 1 end as new from (
                select 'deep' as kind, doc_id, i, 400 as size from deep union all select 'near', doc_id, i, 300 from near) u) v) w
    group by kind, doc_id, s),
gone as (select doc_id, count(*) as n_spans, sum(z - a + 1) as n_removed from runs where kind = 'deep' group by 1),
again as (select doc_id, sum(z - a + 1) as n_repeated from runs where kind = 'near' group by 1),
rest as (
    select doc_id, string_agg(hex(array_slice(b, a, z)), '' order by a) as kept from (
        select r.doc_id, r.z + 1 as a, coalesce(lead(r.a) over (partition by r.doc_id order by r.a) - 1, octet_length(b)) as z, b from runs r join t using (doc_id) where kind = 'deep'
        union all select doc_id, 1, coalesce((select min(r.a) - 1 from runs r where r.kind = 'deep' and r.doc_id = t.doc_id), octet_length(b)), b from t) p
    where z >= a group by 1)
select t.doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256, coalesce(n_repeated, 0)::bigint as n_repeated
from t left join gone using (doc_id) left join again using (doc_id) left join rest using (doc_id)
"""
