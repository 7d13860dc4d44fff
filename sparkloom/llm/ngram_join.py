"""Exact Jaccard join on word n-grams as a blocked sparse product of the document by n-gram incidence matrix.

1. Columns: all n-grams are counted over the corpus by packed messages (packed.py). Those of one document alone can add
   nothing to a product. A row needs an overlap of at least THRESHOLD of its own size, so a row whose shared columns are
   fewer is dropped: it links with nothing. Rows with equal sets become one row.
2. Blocks: of a row in order of rarity only the first n - ceil(t n) + 1 columns (the prefix) can be the first that a
   linked pair shares. Rows that share a prefix column and are of one class of sizes, or the next, are tied; the components
   of these ties are the diagonal blocks: no link leaves one. A component of more than BLOCK_ROWS rows is cut by size and first
   column into a grid; pairs of its blocks that share no prefix column, or whose sizes rule out a link, are discarded.
3. Product: each pair of blocks accumulates overlap counts of sparse columns, and pairs below
   t / (1 + t) * (sizes) are discarded: exactly intersection / union < t. A task returns a row for each document with its
   root and its number of links, never the pairs.
4. The roots' components are the result.

Nothing is sampled or capped. Defined results: null text counts as empty, an empty text has no n-grams and links with
nothing; a text of fewer words than n has one n-gram, its words; rows with a null id link with nothing and have a null
component; rows that share an id are one node. Repeated rows get equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .common import U64, bits_for, blocks, checkpointed, distinct, frugal, keep_memory, let_go, mix, text_bytes, text_size, with_records, words_of_rows
from .components import connected

WORDS, PERCENT, BLOCK_ROWS, SLICE, FEW = 4, 85, 1024, 2048, 12
#: Most entries of a task's table of columns while rows are chained; it is emptied when full.
HEADS = 50_000
#: Rows whose prefix columns are held at once.
ROWS = 500
#: A class of copies is large if it has over 1 / LARGE of all rows.
LARGE = 10_000


def shingles(text: pa.Array | pa.ChunkedArray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and offsets."""
    keep_memory()
    h, words = words_of_rows(*text_bytes(text))
    size = np.diff(words)
    keys = mix(np.arange(n, dtype=np.uint64) + U64(4242)) | U64(1)
    rows, grams = [], []
    with np.errstate(over="ignore"):
        m = len(h) - n + 1
        if m > 0:
            x = h[:m] * keys[0]
            for k in range(1, n):
                x += h[k : k + m] * keys[k]
            row = np.repeat(np.arange(len(size)), size)
            inside = row[:m] == row[n - 1 :]
            rows.append(row[:m][inside])
            grams.append(mix(x[inside]))
        for k in range(1, n):  # texts of k words
            few = np.flatnonzero(size == k)
            if len(few):
                x = np.full(len(few), k, np.uint64)
                for j in range(k):
                    x = mix(x + h[words[few] + j] * keys[j])
                rows.append(few)
                grams.append(x)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(len(size) + 1, np.int64)
    row, gram = np.concatenate(rows), np.concatenate(grams)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return gram[first], np.searchsorted(row[first], np.arange(len(size) + 1))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def product(row: np.ndarray, col: np.ndarray, count: int, a: slice, b: slice) -> np.ndarray:
    """Overlap counts of rows a with rows b: the sparse product of the incidence matrix given by its entries (row, col) with its
    transpose. Columns that hold the same rows count as one with a weight; those of few rows add pair by pair, the others slice
    by slice."""
    order = np.lexsort((row, col))
    row, col = row[order], col[order]
    start = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])) if len(col) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(col)))
    with np.errstate(over="ignore"):
        key = np.add.reduceat(mix(row.astype(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
        key = mix(key) + mix(np.add.reduceat(mix(row.astype(np.uint64) + U64(1 << 40)), start) if len(start) else key)
    _, first, weight = np.unique(key, return_index=True, return_counts=True)
    start, size = start[first], size[first]
    height, width = len(range(count)[a]), len(range(count)[b])
    overlap = np.zeros(height * width)
    few = size <= FEW
    for k in np.unique(size[few]).tolist():
        at = np.flatnonzero(size == k)
        for part in np.array_split(at, -(-len(at) * k * k // 1_000_000)):
            members = row[start[part][:, None] + np.arange(k)]
            i, j, w = np.repeat(members, k, 1).ravel(), np.tile(members, k).ravel(), np.repeat(weight[part], k * k)
            inside = (i >= a.start) & (i < a.stop) & (j >= b.start) & (j < b.stop)
            overlap += np.bincount((i[inside] - a.start) * width + j[inside] - b.start, w[inside], height * width)
    overlap = overlap.reshape(height, width)
    many = np.flatnonzero(~few)
    for part in np.array_split(many, -(-len(many) // SLICE)) if len(many) else ():
        x = np.zeros((count, len(part)), np.float32)
        total = size[part].sum()
        at = np.repeat(start[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(total)
        x[row[at], np.repeat(np.arange(len(part)), size[part])] = 1
        overlap += (x[a] * weight[part].astype(np.float32)) @ x[b].T
    return np.rint(overlap).astype(np.int64)


def links(ids: list, sizes: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, left: int, percent: int) -> tuple[list, list, np.ndarray]:
    """Of rows [0:left] with rows [left:], or of all with all if left is 0: (rows that link, their roots, links with copies)."""
    count = len(ids)
    flat, row = np.concatenate(sets), np.repeat(np.arange(count), [len(s) for s in sets])
    a, b = (slice(0, left), slice(left, count)) if left else (slice(0, count), slice(0, count))
    overlap = product(row, flat, count, a, b)
    linked = 100 * overlap >= percent * (sizes[a][:, None] + sizes[b][None, :] - overlap)
    if not left:
        np.fill_diagonal(linked, False)
    degree = np.zeros(count, np.int64)
    degree[a] += linked @ copies[b]
    if left:
        degree[b] += linked.T @ copies[a]
    label = np.arange(count)
    while True:
        la, lb = label[a], label[b]
        nb = np.minimum(lb, np.where(linked, la[:, None], count).min(0, initial=count))
        na = np.minimum(la, np.where(linked, nb[None, :], count).min(1, initial=count))
        new = label.copy()
        new[b] = np.minimum(new[b], nb)
        new[a] = np.minimum(new[a], na)
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(degree)
    return [ids[k] for k in rows], [ids[label[k]] for k in rows], degree[rows]


def ngram_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links (documents it links with)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    id_sql, id_arrow = id_type.simpleString(), to_arrow_type(id_type)
    size = text_size(docs, text_col)
    n_bytes = size[1]
    bits = bits_for(n_bytes / 6)
    dealt = blocks(docs, id_col, text_col, n_bytes)

    def local(table: pa.Table):
        gram, offsets = shingles(table.column("text"), n)
        keys, inverse, times = distinct(packed.short(gram, bits), bits + 32)
        return gram, offsets, keys, inverse, times

    def send(table: pa.Table) -> pa.Table:
        _, _, keys, _, times = local(table)
        return packed.messages(table.column("blk")[0].as_py(), keys, times)

    row_schema = pa.schema([("id", id_arrow), ("n", pa.int64()), ("digest", pa.binary()), ("shared", pa.binary())])

    def receive(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return row_schema.empty_table()
        gram, offsets, _, inverse, _ = local(table)
        code = packed.answers(replies)[inverse] if len(gram) else np.zeros(0, np.uint8)
        ids, sizes, digests, shared = table.column("id"), np.diff(offsets), [], []
        for k, id_ in enumerate(ids):
            g, c = gram[offsets[k] : offsets[k + 1]], code[offsets[k] : offsets[k + 1]]
            here = c > 0
            if not len(g) or 100 * int(here.sum()) < percent * len(g) or not id_.is_valid:
                digests.append(None)
                shared.append(None)
                continue
            digests.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
            shared.append(g[here][np.lexsort((g[here], c[here]))].tobytes())
        return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(shared, pa.binary())], schema=row_schema)

    replies = packed.count(dealt.groupBy("blk").applyInArrow(frugal(send), packed.MESSAGE))
    rows = checkpointed(dealt.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(frugal(receive), f"id {id_sql}, n long, digest binary, shared binary"))

    del replies
    let_go(docs.sparkSession)
    alive = rows.where("digest is not null")
    classes = alive.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Large classes of copies, fewer than LARGE of them, are broadcast: their rows aren't brought together by digest.
    member = with_records(alive.select("id", "digest").distinct(), checkpointed(classes), ["digest"], F.col("copies") * LARGE > size[0])
    member = checkpointed(member.select("id", "rep", "copies", "digest"))
    own = member.where("id = rep").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "copies")
    reps = alive.join(own, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("id", "n", "shared", "copies", "digest").dropDuplicates(["id", "digest"])
    reps = checkpointed(reps)

    ratio = np.log(100 / percent) * (1 + 1e-9)  # a class is a little wider than sizes that link can differ

    def prefixes(batches):
        for batch in batches:
            for id_, size, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                g = np.frombuffer(s.as_buffer(), np.int64)
                yield id_, size, g[: max(0, prefix(size, percent) - (size - len(g)))]

    def chained(batches):
        """Edges between rows of this task that share a prefix column and a class of sizes, and one row for each such pair."""
        heads: dict = {}

        def out(edges):
            keys = list(heads)
            rows = [(None, None, a, b) for a, b in edges] + [(g, c, heads[g, c], None) for g, c in keys]
            heads.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], id_arrow), pa.array([r[3] for r in rows], id_arrow)], ["gram", "cls", "a", "b"])

        edges = set()
        for id_, size, grams in prefixes(batches):
            cls = int(np.log(size) / ratio) if percent < 100 else size
            for g in grams.tolist():
                first = heads.setdefault((g, cls), id_)
                if first != id_:
                    edges.add((first, id_))
            if len(heads) + len(edges) > HEADS:
                yield out(edges)
                edges = set()
        yield out(edges)

    # Sizes of rows that link differ by no more than a class: rows of one class, and those of the next, are tied. A task sends a
    # column once, however many of its rows have it, so a column that very many rows share is a row a task.
    posted = checkpointed(reps.select("id", "n", "shared").mapInArrow(frugal(chained), f"gram long, cls int, a {id_sql}, b {id_sql}"))
    heads = posted.where("gram is not null")
    least = checkpointed(heads.groupBy("gram", "cls").agg(F.min("a").alias("m")))
    to_least = heads.select("gram", "cls", "a").join(least, ["gram", "cls"]).select("a", F.col("m").alias("b"))
    next_ = least.select("gram", (F.col("cls") + 1).alias("cls"), F.col("m").alias("a")).join(least, ["gram", "cls"]).select("a", F.col("m").alias("b"))
    found = connected(posted.where("gram is null").select("a", "b").unionByName(to_least).unionByName(next_))
    found = found.select(F.col("node").alias("_id"), F.col("component").alias("comp"))

    # Rows of a component in order of size and first column; a grid of blocks where there are more than block_rows. The order
    # comes from counts by (component, size, 3 hex digits of the column), so no task numbers the rows of a component.
    light = reps.select("id", "n", "digest", F.substring(F.hex(F.substring("shared", 1, 2)), 1, 3).alias("g")).join(found, F.col("id") == F.col("_id")).select("id", "n", "g", "digest", "comp")
    light = checkpointed(light)
    counts = light.groupBy("comp", "n", "g").agg(F.count(F.lit(1)).alias("k"))
    by_size = counts.groupBy("comp", "n").agg(F.sum("k").alias("k"))
    sum_before = lambda *order: F.sum("k").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1))
    by_size = by_size.select("comp", "n", F.coalesce(sum_before("comp", "n"), F.lit(0)).alias("start"), F.sum("k").over(Window.partitionBy("comp")).alias("whole"))
    large = by_size.where(F.col("whole") > block_rows).drop("whole")
    inner = counts.join(large, ["comp", "n"]).select("comp", "n", "g", "k", (F.col("start") + F.coalesce(sum_before("comp", "n", "g"), F.lit(0))).alias("start"))
    inner = checkpointed(inner.withColumnsRenamed({"comp": "_comp", "n": "_n", "g": "_g"}))
    nth = F.col("start") + F.pmod(F.xxhash64("id", "digest"), F.col("k"))
    placed = light.join(inner, (F.col("comp") == F.col("_comp")) & (F.col("n") == F.col("_n")) & (F.col("g") == F.col("_g")), "left")
    placed = checkpointed(placed.select("id", "n", "digest", "comp", F.coalesce(F.floor(nth / block_rows), F.lit(0)).cast("int").alias("b"), F.col("k").isNotNull().alias("gridded")))
    spans = placed.groupBy("comp", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("size"))
    other = spans.select(F.col("comp").alias("_comp"), F.col("b").alias("_b"), F.col("low").alias("low2"))
    # Cells of a grid: blocks that share a prefix column, and whose sizes allow a link.
    columns = placed.where("gridded").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "comp", "b").join(reps.select("id", "digest", "n", "shared"), (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")))

    def columns_of(batches):
        """The distinct (component, block, prefix column) of some rows at a time."""
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                number: dict = {}
                cells = [number.setdefault(c, len(number)) for c in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                grams = [g for _, _, g in prefixes([part])]
                pairs = np.unique(np.stack([np.repeat(cells, [len(g) for g in grams]), np.concatenate(grams)], 1), axis=0)
                names = list(number)
                comp, block = (pa.array([c[k] for c in names], kind) for k, kind in ((0, id_arrow), (1, pa.int32())))
                at = pa.array(pairs[:, 0])
                yield pa.RecordBatch.from_arrays([comp.take(at), block.take(at), pa.array(pairs[:, 1])], ["comp", "b", "gram"])

    held = columns.select("id", "n", "shared", "comp", "b").mapInArrow(frugal(columns_of), f"comp {id_sql}, b int, gram long").distinct()
    held = checkpointed(held)
    meet = held.join(held.withColumnRenamed("b", "b2"), ["comp", "gram"]).where("b < b2").select("comp", "b", "b2").distinct()
    meet = meet.unionByName(spans.where("size > 1").select("comp", "b", F.col("b").alias("b2")))
    pairs = meet.join(spans.select("comp", "b", "high"), ["comp", "b"]).join(other, (F.col("comp") == F.col("_comp")) & (F.col("b2") == F.col("_b"))).select("comp", "b", "b2", "high", "low2")
    pairs = pairs.where(F.expr(f"b = b2 or 100 * high >= {percent} * low2"))
    sides = pairs.select("comp", "b", "b2", F.explode(F.array_distinct(F.array("b", "b2"))).alias("side"))
    sides = sides.select(F.col("comp").alias("_comp"), F.col("b").alias("i"), F.col("b2").alias("j"), "side")
    cells = placed.join(sides, (F.col("comp") == F.col("_comp")) & (F.col("b") == F.col("side"))).select("id", "digest", "comp", "i", "j", "side")
    filled = reps.join(cells.withColumnRenamed("id", "_id").withColumnRenamed("digest", "_digest"), (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")))
    # Small components travel together; each cell of a grid by itself.
    alone = F.when(F.col("j") > 0, F.xxhash64("comp", "i", "j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(max(24, n_bytes // 8_000_000))))
    filled = filled.select(alone.alias("bin"), "comp", "i", "j", "side", "id", "n", "shared", "copies")

    out_schema = pa.schema([("a", id_arrow), ("b", id_arrow), ("links", pa.int64())])

    def multiply(table: pa.Table) -> pa.Table:
        keep_memory()
        cells: dict = {}
        for k, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("comp", "i", "j", "side")))):
            cells.setdefault(key[:3], []).append((key[3], k))
        ids, n_, copies, shared = table.column("id").to_pylist(), table.column("n").to_numpy(), table.column("copies").to_numpy(), table.column("shared").combine_chunks() if table.column("shared").num_chunks != 1 else table.column("shared").chunk(0)
        a, b, deg = [], [], []
        for (_, i, j), members in cells.items():
            members.sort()
            at = [k for _, k in members]
            left = sum(1 for side, _ in members if side == i) if i != j else 0
            x = links([ids[k] for k in at], n_[at], [np.frombuffer(shared[k].as_buffer(), np.uint64) for k in at], copies[at], left, percent)
            a += x[0]
            b += x[1]
            deg += x[2].tolist()
        return pa.table([pa.array(a, id_arrow), pa.array(b, id_arrow), pa.array(deg, pa.int64())], schema=out_schema)

    linked = checkpointed(filled.groupBy("bin").applyInArrow(frugal(multiply), f"a {id_sql}, b {id_sql}, links long"))
    comps = connected(linked.select("a", "b"))
    degree = linked.groupBy("a").agg(F.sum("links").alias("others"))
    # Rows that share an id join the classes of all their texts.
    shared_ids = member.select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a <> b")
    several = member.groupBy("id").agg(F.countDistinct("rep").alias("k")).where("k > 1").select(F.col("id").alias("_id"))
    if not several.isEmpty():
        nodes = comps.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")
        comps = connected(nodes.unionByName(shared_ids))
    of_class = member.join(comps, F.col("rep") == F.col("node"), "left").select("id", "digest", "copies", F.coalesce("component", "rep").alias("component"), "rep")
    of_class = of_class.join(degree, F.col("rep") == F.col("a"), "left").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "component", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("id", "n", "digest").join(of_class, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))



def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that a chain of links ties to a smaller id. Rows with a null id stay."""
    found = ngram_join(docs, n, percent, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(checkpointed(gone), docs[id_col] == F.col("__gone_id"), "left_anti")


#: The registered query (n = 4, percent = 85) by counting the shingles that each pair shares.
ORACLE = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
sh as (
    select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
        else list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) end) as g from w),
sz as (select doc_id, count(*) as n from sh group by 1),
both_ as (select a.doc_id as x, b.doc_id as y, count(*) as k from sh a join sh b using (g) where a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from both_ join sz p on p.doc_id = x join sz q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.y from reach r join e on e.x = r.y)
select d.doc_id, coalesce(n, 0) as n_shingles, (select min(y) from reach r where r.x = d.doc_id) as component_id, (select count(*) from e where e.x = d.doc_id) as n_links
from documents d left join sz on sz.doc_id = d.doc_id
"""
