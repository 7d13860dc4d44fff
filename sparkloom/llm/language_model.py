"""Scoring by a hierarchical Pitman-Yor bigram model, its seating sampled by Gibbs.

Restaurants: one for each context word, whose customers are the words that follow it, and one parent that they share,
whose customers are their tables; its base puts half on the unknown word and half evenly on the known ones. With c
customers and t tables of word w in restaurant u, and totals c_u, t_u:
    P(w | u) = (c - d t + (theta + d t_u) P(w)) / (theta + c_u),
and the parent has the same form. The probabilities of all words and the unknown one sum to one.

Gibbs sampling. CHAINS chains start from a draw against word shares and make ``sweeps`` sweeps each. In a sweep all customers of
a dish leave their tables and are seated again: the number of tables t is drawn from its conditional given everything else,
proportional to S_d(c, t) * prod_{i<t} (theta + d (t_- + i)) * P(w)^t, where S_d are the generalised Stirling numbers (the ways
to seat c customers at t tables), t_- counts the restaurant's other tables, and P(w) is the parent's prediction under its
current seating. First the contexts are seated again, then the parent given the tables that they sent. Dishes of one step
are drawn at once, given the totals of the step before. Dishes with more than EXACT customers are drawn from the limit of that
conditional for large counts (many_tables()). The prediction is the average of the chains' probabilities.

Data flow. The documents are dealt into blocks and tokenised once, and the tokens written. In each step a block sends distinct keys to buckets and gets
answers: words (how often each occurs in training, its tables as a dish and as a context), and pairs (customers, and which
block owns a pair, so that sums count it once). A block seats the customers of its own pairs itself, sweep by sweep, and keeps
them in rows of its own, so that only words travel between sweeps; the tables after the last sweep go to all blocks that have
the pair. Pairs of one customer have one table, which is not sent. Keys go as packed sorted arrays; random numbers come from hashes of the keys, so a task that is run again draws the
same. Counts cover the whole corpus; pairs are told apart by at least 44 bits of a hash (in a bucket of 1.5 million, 40), so of a
million pairs about one shares its counts with another; words by at least 60.

Defined results: null text counts as empty: one end token. Words unknown in training are one symbol. Without training rows
all words are unknown and N and V are 0. Null ids are allowed; repeated rows get equal results, each counts in training;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bits_for, blocks, checkpointed, crc_mod, expand, in_rows, keep_memory, mix, sorted_places, squeeze, text_bytes, text_size, width_for, words_of_rows, written_by_block
from .packed import from_planes, planes, short

DISCOUNT, THETA, ROOT_DISCOUNT, ROOT_THETA, CHAINS, SWEEPS, EXACT = 0.8, 2.0, 0.6, 10.0, 4, 3, 256
#: Most customers whose weights are multiplied as they are; beyond, as logarithms.
PLAIN = 24
MODULUS, HELD = 10, 0
END, BEGIN = mix(np.array([0xE0D, 0xB09], np.uint64))
PAIR_WIDTH = 40
#: The step of the rows that blocks keep for themselves.
STATE = -1
MESSAGE = "bucket int, blk int, keys binary, load binary"
REPLY = "blk int, stage int, bucket int, code binary, totals array<double>"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("keys", pa.binary()), ("load", pa.binary())])
_REPLY = pa.schema([("blk", pa.int32()), ("stage", pa.int32()), ("bucket", pa.int32()), ("code", pa.binary()), ("totals", pa.list_(pa.float64()))])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)


def unpack(raw, n: int, *kinds: str) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.uint8), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(k)[:, 0])
        at += n * size
    return out


def pack_chains(*arrays: np.ndarray, chains: int = CHAINS) -> bytes:
    """Counts of several chains, groups of `chains` arrays: the first of a group as it is, the others as differences from it."""
    out = []
    for k in range(0, len(arrays), chains or 1):
        first = arrays[k].astype(np.int64)
        change = [x.astype(np.int64) - first for x in arrays[k + 1 : k + chains]]
        out += [first.astype(np.uint32), *((d << 1 ^ d >> 63).astype(np.uint32) for d in change)]  # the sign in the low bit
    return pack(*out)


def unpack_chains(raw, n: int, groups: int, chains: int = CHAINS) -> list[np.ndarray]:
    got, out = unpack(raw, n, *["u4"] * (groups * chains)), []
    for k in range(0, len(got), chains or 1):
        first = got[k].astype(np.int64)
        change = [x.astype(np.int64) for x in got[k + 1 : k + chains]]
        out += [first, *(first + (x >> 1 ^ -(x & 1)) for x in change)]
    return out


def pack_seats(customers: np.ndarray, owner: np.ndarray, *seats: np.ndarray) -> bytes:
    """Most pairs have one customer, so one table, and one owner: only the others' owner bits and tables (of each chain) are
    sent, and counts from 255 in full."""
    small = np.minimum(customers, 255).astype(np.uint8)
    many, big = small >= 2, small == 255
    return small.tobytes() + pack_chains(*(s[many] for s in seats), chains=len(seats)) + np.packbits(owner[many]).tobytes() + pack(customers[big].astype(np.uint32))


def unpack_seats(raw, n: int, chains: int = CHAINS) -> tuple[np.ndarray, ...]:
    flat = np.frombuffer(raw, np.uint8)
    small = flat[:n]
    many, big = np.flatnonzero(small >= 2), np.flatnonzero(small == 255)
    customers, owner = small.astype(np.uint32), np.zeros(n, np.uint8)
    at = n + 4 * chains * len(many)
    seats = [np.minimum(small, 1).astype(np.uint32) for _ in range(chains)]
    for s, got in zip(seats, unpack_chains(flat[n:at], len(many), 1, chains)):
        s[many] = got
    owner[many] = np.unpackbits(flat[at : at + -(-len(many) // 8)], count=len(many))
    (customers[big],) = unpack(flat[at + -(-len(many) // 8) :], len(big), "u4")
    return customers, owner, *seats


def send(blk: int, keys: np.ndarray, width: int, *load: np.ndarray, coded: Callable = pack) -> pa.Table:
    bucket = (keys >> U64(width)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    spans = list(zip(cut, cut[1:]))
    return pa.table([pa.array(bucket[cut[:-1]] if spans else [], pa.int32()), pa.array([blk] * len(spans), pa.int32()), pa.array([squeeze(planes(keys[a:b], width)) for a, b in spans], pa.binary()), pa.array([squeeze(coded(*(x[a:b] for x in load))) for a, b in spans], pa.binary())], schema=_MESSAGE)


def answer(side: pa.Table, stage: int, width: int, keys: np.ndarray, decode: Callable) -> list[np.ndarray]:
    """What the buckets of a step reply for these sorted keys, of which there is at least one."""
    at = np.flatnonzero((side.column("stage").to_numpy() == stage) & (side.column("bucket").to_numpy() >= 0))
    mine = side.take(pa.array(at, pa.int64()))
    bucket, sizes = np.unique((keys >> U64(width)).astype(np.int64), return_counts=True)
    sizes = dict(zip(bucket.tolist(), sizes.tolist()))
    got = sorted(zip(mine.column("bucket").to_pylist(), mine.column("code")), key=lambda r: r[0])
    return [np.concatenate(x) for x in zip(*(decode(expand(code.as_buffer()), sizes[b]) for b, code in got))]


def reduce_bucket(table: pa.Table, width: int, stage: int, decode: Callable, work: Callable, coded: Callable = pack) -> pa.Table:
    """work(key number of each entry, distinct keys, loads, entries by key and block) gives answers for each entry, and totals."""
    keep_memory()
    table = table.take(pa.array(np.argsort(table.column("blk").to_numpy(), kind="stable")))
    keys = [from_planes(expand(k.as_buffer()), width) for k in table.column("keys")]
    sizes = list(map(len, keys))
    loads = [decode(expand(x.as_buffer()), n) for x, n in zip(table.column("load"), sizes)]
    blk, bucket = table.column("blk").to_pylist(), table.column("bucket")[0].as_py()
    keys = np.concatenate(keys)
    keys, order = sorted_places(keys, width)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    answers, totals = work(inverse, keys[new] + U64(bucket << width), [np.concatenate(x) for x in zip(*loads)], order)
    cut, n = np.cumsum([0, *sizes]), len(blk)
    code = [squeeze(coded(*(a[i:j] for a in answers))) for i, j in zip(cut, cut[1:])]
    return pa.table([pa.array([*blk, -1], pa.int32()), pa.array([stage] * (n + 1), pa.int32()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*code, None], pa.binary()), pa.array([None] * n + [list(map(float, totals))], pa.list_(pa.float64()))], schema=_REPLY)


@functools.cache
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c and t up to most: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
            out[c + 1, 0] = -np.inf
    return out


def chosen(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A draw from each column of weights for 1, 2, ..."""
    w = np.cumsum(w, axis=0)
    return 1 + (w < u * w[-1]).sum(0)


def uniform(seed: np.ndarray) -> np.ndarray:
    return (mix(seed) >> U64(11)).astype(np.float64) / 2.0**53


def saddle(count: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t with weights S_d(c, t) a^t, to leading order for large c. sum_t S_d(c, t) a^t is c! times the
    coefficient of z^c in exp(a g(z)), g(z) = (1 - (1 - z)^d) / d; the saddle point has a z (1 - z)^(d - 1) = c."""
    low, high, goal = np.full(len(a), -400.0), np.zeros(len(a)), np.log(count) - np.log(a)
    for _ in range(26):
        log_q = (low + high) / 2
        more = np.log(np.maximum(-np.expm1(log_q), 1e-300)) + (discount - 1) * log_q > goal
        low, high = np.where(more, log_q, low), np.where(more, high, log_q)
    q = np.exp(low)
    mean = a * -np.expm1(discount * low) / discount
    # How q moves with log a, from the logarithm of the saddle's equation.
    return mean, mean - a * q**discount / (1 / np.maximum(1 - q, 1e-300) * q + 1 - discount)


def many_tables(count: np.ndarray, x: np.ndarray, p: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """tables() of dishes with more than EXACT customers: a normal draw. Mean and variance are those of the saddle point, put
    right by what it misses at EXACT customers and a (c / EXACT)^-d, where few tables are as far from the limit."""
    row, k, t = log_stirling(discount)[EXACT, 1:], np.arange(1, EXACT + 1), np.ones(len(count))
    for _ in range(4):  # a and t settle each other
        t = np.clip(saddle(count, np.maximum((x + discount * t) * p, 1e-9), discount)[0], 1, count)
    for _ in range(2):
        a = np.maximum((x + discount * t) * p, 1e-9)
        less = a * (count / EXACT) ** -discount
        log_w = np.log(less)[:, None] * k + row
        w = np.exp(log_w - log_w.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        mean = w @ k
        spread = w @ k**2 - mean**2
        (far, far_spread), (near, near_spread) = saddle(count, a, discount), saddle(np.full(len(count), float(EXACT)), less, discount)
        t = np.clip(far + mean - near, 1, count)
    spread = np.maximum(far_spread + spread - near_spread, 1e-6)
    spread = 1 / np.maximum(1 / spread - discount / (x + discount * t), 0.2 / spread)  # the weight grows with t, too
    normal = np.sqrt(-2 * np.log(1 - uniform(seed + U64(1 << 40)))) * np.cos(2 * np.pi * uniform(seed + U64(1 << 41)))
    return np.clip(np.floor(t + np.sqrt(spread) * normal + uniform(seed)), 1, count)


def tables(count: np.ndarray, x: np.ndarray, p: np.ndarray, discount: float, seed: np.ndarray) -> np.ndarray:
    """For each dish, its tables: a draw from S_d(c, t) * prod_{i<t} (x + d i) * p^t; beyond EXACT customers, see many_tables()."""
    out = np.minimum(count, 1).astype(np.int64)
    stirling, u = log_stirling(discount), uniform(seed)
    many = np.flatnonzero(count > 1)
    sizes = np.minimum(count[many], EXACT + 1).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    many, sizes = many[order], sizes[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]]) if len(many) else []
    for a, b in zip(edges[:-1], edges[1:]):
        c = int(sizes[a])
        step = max(1, 500_000 // c)
        for first in range(a, b, step):
            at = many[first : min(first + step, b)]
            if c > EXACT:
                out[at] = many_tables(count[at], x[at], p[at], discount, seed[at])
            else:
                grow = (x[at] + discount * np.arange(c)[:, None]) * p[at]
                ways = stirling[c, 1 : c + 1, None]
                if c <= PLAIN:
                    w = np.cumprod(grow, axis=0) * np.exp(ways)
                else:
                    log_w = np.cumsum(np.log(np.maximum(grow, 1e-300)), axis=0) + ways
                    w = np.exp(log_w - log_w.max(0))
                out[at] = chosen(w, u[at])
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = MODULUS, held: int = HELD, chains: int = CHAINS, sweeps: int = SWEEPS, tokens: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), known_score (that of known tokens
    alone), perplexity (10 to the power of -score / n_tokens); with tokens, also log_p: the log10 probability of each token."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    id_sql, id_arrow = id_type.simpleString(), to_arrow_type(id_type)
    _, n_bytes = text_size(docs, text_col)
    word_bits, pair_bits = bits_for(n_bytes / 60), bits_for(n_bytes / 8)
    word_width = width_for(word_bits)

    sums: dict[int, list[float]] = {}  # totals by step
    in_chains = functools.partial(pack_chains, chains=chains)

    def chained(groups: int) -> Callable:
        return lambda raw, n: unpack_chains(raw, n, groups, chains)


    def tokenised(table: pa.Table) -> pa.Table:
        """One row for a block: its distinct words (end and begin included), sorted, and the number of each token's word."""
        keep_memory()
        h, words = words_of_rows(*text_bytes(table.column("text")))
        n = len(words) - 1
        cut = words + np.arange(n + 1)
        token = np.full(len(h) + n, END, np.uint64)
        own = np.ones(len(token), bool)
        own[cut[1:] - 1] = False
        token[own] = h
        # By a hash table; numbered by frequency, as small numbers pack well. The last two are END and BEGIN.
        code, words = pd.factorize(np.concatenate([short(token, word_bits, word_width), short(np.array([END, BEGIN]), word_bits, word_width)]))
        often = np.argsort(-np.bincount(code), kind="stable")
        number = np.empty(len(words), np.int64)
        number[often] = np.arange(len(words))
        by_word = np.argsort(words)
        parts = [np.diff(cut).astype(np.uint32), number[code].astype(np.uint32), number[by_word].astype(np.uint32), words[by_word]]
        return pa.table([pa.array([table.column("blk")[0].as_py()], pa.int32()), pa.array([table.column("id").to_pylist()], pa.list_(id_arrow)), pa.array([list(map(len, parts))], pa.list_(pa.int64())), pa.array([[squeeze(pack(x)) for x in parts]], pa.list_(pa.binary()))], names=["blk", "ids", "sizes", "parts"])

    def parent_seats(side: pa.Table, sweep: int, words: np.ndarray) -> list[np.ndarray]:
        """After a sweep, of words that occur more than once, in each chain: customers and tables in the parent, tables as a context."""
        got = answer(side, 2 + 2 * sweep, word_width, words, chained(3))
        return [np.stack(got[k : k + chains]) for k in range(0, 3 * chains, chains)]

    def predicted(sweep: int, customers: np.ndarray, t: np.ndarray, base: np.ndarray | float) -> np.ndarray:
        """The parent's prediction after a sweep, in each chain."""
        totals, once = np.array(sums[2 + 2 * sweep]), sums[0][2]
        root_c, root_t = totals[:chains, None] + once, totals[chains:, None] + once
        return (customers - ROOT_DISCOUNT * t + (ROOT_THETA + ROOT_DISCOUNT * root_t) * base) / (ROOT_THETA + root_c)

    class Block:
        """Tokens of a block, its distinct words and pairs, and how often training rows have each."""

        def __init__(self, table: pa.Table):
            keep_memory()
            self.blk, self.ids = table.column("blk")[0].as_py(), table.column("ids")[0].values
            raw, n = table.column("parts")[0].values, table.column("sizes")[0].as_py()
            sizes, code, number, self.words = (unpack(expand(x.as_buffer()), k, kind)[0] for x, k, kind in zip(raw, n, ("u4", "u4", "u4", "u8")))
            place = np.empty(len(number), np.int64)
            place[number] = np.arange(len(number))
            code = place[code]
            self.cut = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            self.word, self.end, self.begin = code[:-2], int(code[-2]), int(code[-1])
            self.held = crc_mod(self.ids.to_pylist(), modulus) == held
            self.train = np.repeat(~self.held, np.diff(self.cut))
            self.word_times = np.bincount(self.word[self.train], minlength=len(self.words)).astype(np.uint32)

        def add_pairs(self) -> Block:
            """Also the distinct pairs of a context and a word, in order of their keys."""
            v, n = len(self.words), len(self.word)
            context = np.empty_like(self.word)
            context[1:] = self.word[:-1]
            context[self.cut[:-1]] = self.begin
            pair, low = context * v + self.word, n.bit_length()
            if (v * v).bit_length() + low <= 63:  # a token's place is sorted along in the low bits
                pair = np.sort(pair << low | np.arange(n))
                order, pair = pair & ((1 << low) - 1), pair >> low
            else:
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            self.pair = np.empty(n, np.int64)
            context, word = np.divmod(pair[new], v)
            key = short(mix(mix(self.words[context]) + self.words[word]), pair_bits, PAIR_WIDTH)
            by_key = np.argsort(key)
            place = np.empty(len(key), np.int64)
            place[by_key] = np.arange(len(key))
            self.pair[order] = place[np.cumsum(new) - 1]
            self.pairs, self.pair_context, self.pair_word = key[by_key], context[by_key], word[by_key]
            self.pair_times = np.bincount(self.pair[self.train], minlength=len(key)).astype(np.uint32)
            return self

        def counts(self, side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """Training count of each word, and of each word as a context."""
            (c,) = answer(side, 0, word_width, self.words, lambda raw, n: unpack(raw, n, "u4"))
            c = c.astype(np.float64)
            as_context = c.copy()
            as_context[self.begin], as_context[self.end] = c[self.end], 0
            return c, as_context

        def customers(self, side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """Of each pair: customers, and whether this block owns it."""
            c, mine = answer(side, 1, PAIR_WIDTH, self.pairs, lambda raw, n: unpack_seats(raw, n, 0))
            return c.astype(np.int64), np.where(c == 1, self.pair_times > 0, mine > 0)

        def seats(self, side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """Of each pair: customers, and its tables in each chain after the last sweep."""
            c, _ = self.customers(side)
            t, many = np.tile(np.minimum(c, 1), (chains, 1)), np.flatnonzero(c > 1)
            if len(many):
                t[:, many] = answer(side, 3, PAIR_WIDTH, self.pairs[many], chained(1))
            return c, t

        def parent(self, side: pa.Table, sweep: int, c: np.ndarray, as_context: np.ndarray, v: float) -> tuple[np.ndarray, np.ndarray]:
            """After a sweep, for each chain: the parent's prediction of each word, and the tables of each context."""
            several = np.flatnonzero(np.maximum(c, as_context) > 1)
            # A word that occurs once is one customer at one table, and so is the word after it.
            customers, t, context = (np.tile((x == 1).astype(np.int64), (chains, 1)) for x in (c, c, as_context))
            if len(several):
                customers[:, several], t[:, several], context[:, several] = parent_seats(side, sweep, self.words[several])
            return predicted(sweep, customers, t, np.where(c > 0, 0.5 / max(v, 1), 0.5) if v else np.ones(len(c))), context

    def send_words(table: pa.Table) -> pa.Table:
        b = Block(table)
        return send(b.blk, b.words, word_width, b.word_times)

    def count_words(inverse, distinct, loads, order):
        total = np.bincount(inverse, loads[0])
        return [total[inverse].astype(np.uint32)], [total.sum(), (total > 0).sum(), (total == 1).sum()]

    def owners(inverse, times, order):
        """The owner is the least block that has the pair in training."""
        there = order[times[order] > 0]
        head = np.ones(len(there), bool)
        head[1:] = inverse[there][1:] != inverse[there][:-1]
        owner = np.zeros(len(inverse), np.uint8)
        owner[there[head]] = 1
        return owner

    def send_pairs(table: pa.Table) -> pa.Table:
        b = Block(table).add_pairs()
        return send(b.blk, b.pairs, PAIR_WIDTH, b.pair_times)

    def count_pairs(inverse, distinct, loads, order):
        total = np.bincount(inverse, loads[0].astype(np.float64)).astype(np.int64)
        return [total[inverse].astype(np.uint32), owners(inverse, loads[0], order)], [total.sum()]

    def state_of(blk: int, *parts: np.ndarray) -> pa.Table:
        """What a block keeps from sweep to sweep, a row for each part: its words that occur more than once, the tables of its
        pairs of one customer by word and by context, and of its own pairs of several customers the keys, contexts, words,
        customers, and the tables in each chain."""
        k = len(parts)
        return pa.table([pa.array([blk] * k, pa.int32()), pa.array([STATE] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([squeeze(pack(x)) for x in parts], pa.binary()), pa.array([[float(len(x))] for x in parts], pa.list_(pa.float64()))], schema=_REPLY)

    def state_parts(table: pa.Table) -> list[np.ndarray]:
        rows = (r for r in table.to_pylist() if r["stage"] == STATE)
        parts = [unpack(expand(r["code"]), int(r["totals"][0]), "u8" if r["bucket"] in (0, 3) else "u4")[0] for r in sorted(rows, key=lambda r: r["bucket"])]
        return [x if x.dtype == np.uint64 else x.astype(np.int64) for x in parts]

    def start(table: pa.Table, side: pa.Table) -> pa.Table:
        """A new table weighs as if half a context's customers had tables of their own, against word shares."""
        if not table.num_rows:
            return _REPLY.empty_table()
        b = Block(table).add_pairs()
        c, as_context = b.counts(side)
        customers, mine = b.customers(side)
        several = np.flatnonzero(np.maximum(c, as_context) > 1)
        place = np.zeros(len(c), np.int64)
        place[several] = np.arange(len(several))
        single, own = np.flatnonzero(mine & (customers == 1)), np.flatnonzero(mine & (customers > 1))
        once = [np.bincount(key[single], minlength=len(c))[several].astype(np.uint32) for key in (b.pair_word, b.pair_context)]
        context, word, customers = b.pair_context[own], b.pair_word[own], customers[own]
        weight, small = (THETA + DISCOUNT * 0.5 * as_context[context]) * c[word] / max(sums[0][0], 1), np.full(len(own), 1e-9)
        t = [tables(customers, weight / small, small, DISCOUNT, mix(b.pairs[own] + U64(chain))) for chain in range(chains)]
        return state_of(b.blk, b.words[several], *once, b.pairs[own], *(x.astype(np.uint32) for x in (place[context], place[word], customers, *t)))

    def seat_pairs(sweep: int, v: float) -> Callable:
        """A block seats the customers of its own pairs again, in each chain, given the parent after the sweep before."""

        def run(table: pa.Table, side: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _REPLY.empty_table()
            keep_memory()
            words, by_word, by_context, keys, context, word, customers, *t = state_parts(table)
            if len(keys):
                root, root_t, tables_of = parent_seats(side, sweep - 1, words)
                p = predicted(sweep - 1, root, root_t, 0.5 / max(v, 1))
                for k in range(chains):
                    x = THETA + DISCOUNT * (tables_of[k][context] - t[k])
                    t[k] = tables(customers, x, p[k][word], DISCOUNT, mix(keys + U64(131 * sweep + k)))
            return state_of(table.column("blk")[0].as_py(), words, *(x.astype(np.uint32) for x in (by_word, by_context)), keys, *(x.astype(np.uint32) for x in (context, word, customers, *t)))

        return run

    def send_tables(table: pa.Table) -> pa.Table:
        words, by_word, by_context, _, context, word, _, *t = state_parts(table)
        sent = [np.bincount(key, x, len(words)).astype(np.int64) + once for key, once in ((word, by_word), (context, by_context)) for x in t]
        return send(table.column("blk")[0].as_py(), words, word_width, *sent, coded=in_chains)

    def send_seats(table: pa.Table, side: pa.Table) -> pa.Table:
        """The tables of pairs of several customers after the last sweep, from their owners; 0 from other blocks."""
        if not table.num_rows:
            return _MESSAGE.empty_table()
        b = Block(table).add_pairs()
        customers, mine = b.customers(side)
        many = np.flatnonzero(customers > 1)
        t = np.zeros((chains, len(many)), np.int64)
        t[:, mine[many]] = np.stack(state_parts(side)[7:])
        return send(b.blk, b.pairs[many], PAIR_WIDTH, *t, coded=in_chains)

    def hand_out(inverse, distinct, loads, order):
        t = [np.bincount(inverse, x.astype(np.float64)) for x in loads]
        return [x[inverse] for x in t], [x.sum() for x in t]

    def seat_parent(sweep: int, v: float, before: list[float]) -> Callable:
        """before: the parent's tables in each chain after the sweep before; at the start, one for each word."""

        def work(inverse, distinct, loads, order):
            customers = [np.bincount(inverse, x.astype(np.float64)) for x in loads[:chains]]
            by_context = [np.bincount(inverse, x.astype(np.float64)) for x in loads[chains:]]
            seated, totals = [], []
            for chain, c in enumerate(customers):
                x = ROOT_THETA + ROOT_DISCOUNT * max(before[chain] - 1, 0)
                t = tables(c.astype(np.int64), np.full(len(c), x), np.full(len(c), 0.5 / max(v, 1)), ROOT_DISCOUNT, mix(distinct + U64(977 * (sweep + 1) + chain)))
                seated.append(t)
                totals.append(t.sum())
            return [x[inverse] for x in (*customers, *seated, *by_context)], [*(c.sum() for c in customers), *totals]

        return work

    out_schema = pa.schema([("doc_id", id_arrow), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("known_score", pa.float64()), ("perplexity", pa.float64())] + [("log_p", pa.list_(pa.float64()))] * tokens)

    def finish(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        b = Block(table).add_pairs()
        c, as_context = b.counts(side)
        n, v, _ = sums[0][:3]
        pair_c, pair_t = b.seats(side)
        parent, context_t = b.parent(side, sweeps, c, as_context, v)
        p = np.zeros(len(b.pairs))
        for chain in range(chains):
            share = np.where(as_context > 0, (THETA + DISCOUNT * context_t[chain]) / (THETA + as_context), 1.0)
            p += np.where(pair_c > 0, pair_c - DISCOUNT * pair_t[chain], 0) / (THETA + as_context[b.pair_context]) + share[b.pair_context] * parent[chain][b.pair_word]
        log_p = np.log10(p / chains)[b.pair]
        sizes = np.diff(b.cut)
        known = (c > 0)[b.word]
        base_score = in_rows(np.log10(c + 0.1)[b.word], b.cut) - sizes * np.log10(n + 0.1 * (v + 1))
        total = in_rows(log_p, b.cut)
        columns = [b.ids.cast(id_arrow), b.held, sizes, in_rows(known.astype(np.int64), b.cut), np.full(len(sizes), int(n)), base_score, total, in_rows(np.where(known, log_p, 0.0), b.cut), 10.0 ** (-total / sizes)]
        if tokens:
            columns.append(pa.ListArray.from_arrays(pa.array(b.cut, pa.int32()), pa.array(log_p)))
        return pa.table([pa.array(x, f.type) if isinstance(x, np.ndarray) else x for x, f in zip(columns, out_schema)], schema=out_schema)

    # The tokens of all blocks, written in the partitions that all steps use: no step reads or shuffles a text again.
    made = f"blk int, ids array<{id_sql}>, sizes array<long>, parts array<binary>"
    by_block = written_by_block(blocks(docs, id_col, text_col, n_bytes), n_bytes, tokenised, made).groupBy("blk")

    side: dict[int, DataFrame] = {}

    def reduced(sent: DataFrame, width: int, stage: int, decode: Callable, work: Callable, coded: Callable = pack) -> list[float]:
        """Writes the replies of a step, in the partitions of the blocks; its totals, a few numbers, go with the next steps' code."""
        replies = written_by_block(sent.groupBy("bucket").applyInArrow(lambda t: reduce_bucket(t, width, stage, decode, work, coded), REPLY), n_bytes)
        some = replies.where("blk = -1").select(F.posexplode("totals").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
        sums[stage] = [r["x"] for r in some.orderBy("k").collect()] or [0.0] * max(3, 2 * chains)
        side[stage] = replies
        return sums[stage]

    def told(*stages: int):
        return functools.reduce(DataFrame.unionByName, (side[k] for k in dict.fromkeys(stages))).groupBy("blk")

    plain = lambda *kinds: lambda raw, n: unpack(raw, n, *kinds)
    totals = reduced(by_block.applyInArrow(send_words, MESSAGE), word_width, 0, plain("u4"), count_words)
    v, once = totals[1], totals[2]
    reduced(by_block.applyInArrow(send_pairs, MESSAGE), PAIR_WIDTH, 1, plain("u4"), count_pairs, pack_seats)
    state = written_by_block(by_block.cogroup(told(0, 1)).applyInArrow(start, REPLY), n_bytes)
    root_tables = [v] * chains
    for sweep in range(sweeps + 1):
        if sweep:
            state = written_by_block(state.groupBy("blk").cogroup(told(2 * sweep)).applyInArrow(seat_pairs(sweep, v), REPLY), n_bytes)
            del side[2 * sweep]  # what only this sweep needed can go
        totals = reduced(state.groupBy("blk").applyInArrow(send_tables, MESSAGE), word_width, 2 + 2 * sweep, chained(2), seat_parent(sweep, v, root_tables), in_chains)
        root_tables = [t + once for t in totals[chains:]]
    asking = by_block.cogroup(side[1].unionByName(state).groupBy("blk")).applyInArrow(send_seats, MESSAGE)
    reduced(asking, PAIR_WIDTH, 3, chained(1), hand_out, in_chains)
    del state, asking
    last = told(0, 1, 3, 2 + 2 * sweeps)
    return by_block.cogroup(last).applyInArrow(finish, f"doc_id {id_sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double, perplexity double" + ", log_p array<double>" * tokens)
