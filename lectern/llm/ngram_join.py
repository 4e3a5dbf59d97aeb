"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct k-word shingles; two documents link when
100 * |intersection| >= percent * |union|. Steps, none of which drops a link:

1.  A count-min sketch of all shingles (fixed size, summed over tasks) orders the
    shingles rare first. Any order gives the same links; a rare-first one gives few candidates.
2.  Equal sets collapse into one node, nodes with equal prefix and size into one group.
    Only the prefix, n - ceil(t n) + 1 shingles, is indexed: linked sets share one of these.
3.  The index is dealt by shingle in packed pieces. Each posting list links its groups
    to the least group that size allows (a star, not all pairs).
4.  Stars are expanded to nodes; pairs that sizes or bitmaps (step 5) rule out go, the others are
    verified on the whole sets; components follow.
5.  Lists whose nodes lie in several components yet are paired across these
    components and verified: first each node's nearest, in random blocks and then in whole
    lists, which joins most components with few pairs, then all pairs that are left, so each
    pair that could join two components is tried. A parity bitmap of each set bounds a pair's symmetric difference from below; pairs
    whose bound is too high for the threshold can't link and are never made.
6.  Links hold within components only. In a component of three nodes or more all pairs are
    compared by their whole sets, in blocks, and each node's links are counted there.

Defined results: null or blank text has n = 0 and links with nothing; fewer than k words
are one shingle; repeated rows each get a row; a null id is never a component's name
(a component without ids has null); the result names its own columns alone, so other columns of
the input, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, cut, own, release, row_key, settled, small_side, tidy
from .kernels import chunks, mix, sequence_hash, shingle_sets

CELLS = 1 << 22
PARTS = 16  # of the sketch
MERGED = 64  # tasks' counts of a part that are added in one task
WORDS = 16  # of a parity bitmap: 1024 bits
PIECE = 1 << 20  # postings of a packed piece's bucket, about
BLOCK = 512  # nodes of a posting list or of a component that meet as many others under one key


def _sketch(k: int):
    def run(batches):
        from pyspark import TaskContext

        cells, seen = np.zeros(CELLS, dtype=np.uint32), set()
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                new = []
                for s in shingle_sets(buf, offs, k):
                    if len(s) and (key := sequence_hash(s)) not in seen:
                        seen.add(key)
                        new.append(s)
                if new:
                    np.add(cells, np.bincount((np.concatenate(new) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), out=cells, casting="unsafe")
        yield _parts(TaskContext.get().partitionId(), np.minimum(cells, 255).astype(np.uint8))

    return run


def _parts(task: int, cells: np.ndarray) -> pa.RecordBatch:
    step = CELLS // PARTS
    data = [pa.compress(pa.py_buffer(cells[i * step : (i + 1) * step]), codec="zstd", asbytes=True) for i in range(PARTS)]
    return pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "task": pa.array([task] * PARTS, pa.int32()), "cells": pa.array(data, pa.binary())})


def _cells(data: pa.Buffer) -> np.ndarray:
    """A part's counts; sums have two bytes each, the counts of one task one."""
    for kind in ("<u2", "u1"):
        size = CELLS // PARTS * np.dtype(kind).itemsize
        try:
            raw = pa.decompress(data, size, codec="zstd")
        except (pa.ArrowInvalid, OSError):
            continue
        if raw.size == size:
            return np.frombuffer(raw, dtype=kind)
    raise ValueError("not the counts of a part")


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // PARTS, dtype=np.uint32)
    for x in table.column("cells"):
        total += _cells(x.as_buffer())
    data = pa.compress(pa.py_buffer(np.minimum(total, 65535).astype("<u2")), codec="zstd", asbytes=True)
    return pa.table({"part": table.column("part")[:1], "task": table.column("task")[:1], "cells": pa.array([data], pa.binary())})


def sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Estimated counts of all shingles by cell; its size does not depend on the input. Tasks' counts are added MERGED at a time."""
    tasks, parts = texts.rdd.getNumPartitions(), texts.mapInArrow(tidy(_sketch(k)), "part int, task int, cells binary")
    while tasks > 1:
        tasks = -(-tasks // MERGED)
        parts = parts.withColumn("task", F.floor(F.col("task") / MERGED).cast("int")).groupBy("part", "task").applyInArrow(_add, "part int, task int, cells binary")
    out = np.zeros(CELLS, dtype=np.uint16)
    for p in parts.collect():
        out[p.part * (CELLS // PARTS) : (p.part + 1) * (CELLS // PARTS)] = _cells(pa.py_buffer(p.cells))
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """Bit i: whether the set holds an odd number of shingles of cell i. Differing bits of two sets are at most as many as their symmetric difference."""
    return _odd(s, 64 * WORDS).view("<i8")


def _odd(s: np.ndarray, cells: int) -> np.ndarray:
    return np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) & (cells - 1), minlength=cells) & 1).astype(np.uint8))


def wide_bytes(n: int) -> int:
    """Bytes of the wide bitmap of an n-set: two to four bits a shingle, for sets that fill the other bitmap."""
    return 0 if n <= 64 * WORDS else min(1 << (2 * n - 1).bit_length(), 1 << 24) // 8


def wide_parity(s: np.ndarray) -> bytes:
    """`parity` over as many cells as `wide_bytes` says."""
    size = wide_bytes(len(s))
    return _odd(s, 8 * size).tobytes() if size else b""


def wide_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two wide bitmaps; the larger is folded, which keeps each cell's parity."""
    if len(x) > len(y):
        x, y = y, x
    both = np.bitwise_xor.reduce(np.frombuffer(y, dtype=np.uint8).reshape(-1, len(x)), axis=0) ^ np.frombuffer(x, dtype=np.uint8)
    return int(np.bitwise_count(both).sum())


def prefix_length(n, percent: int):
    """Shingles of an n-set that are indexed: two linked sets share one of them."""
    return n - (percent * n + 99) // 100 + 1


NO_BITS = np.zeros(WORDS, dtype="<i8")
BITS = [f"bits{i}" for i in range(WORDS)]
_POST = np.dtype([("token", "<u8"), ("group", "<i8"), ("n", "<i4")])
_RUN = np.dtype([("group", "<i8"), ("n", "<i4"), ("size", "<i4")])  # postings of one group, one after the other
_NODE = np.dtype([("key", "<i8"), ("id", "<i8"), ("known", "<i4"), ("n", "<i4"), ("node", "<i8"), ("group", "<i8"), ("bits", "<i8", WORDS)])


def _post_bytes(rows: np.ndarray) -> bytes:
    """Packed postings of a bucket: their number, each group's run, and 32 bits of each token. Tokens that these confuse only share a list; sets are compared whole."""
    first = np.flatnonzero(np.concatenate(([True], (rows["group"][1:] != rows["group"][:-1]) | (rows["n"][1:] != rows["n"][:-1]))))
    runs = np.empty(len(first), dtype=_RUN)
    runs["group"], runs["n"], runs["size"] = rows["group"][first], rows["n"][first], np.diff(np.append(first, len(rows)))
    return np.int64(len(first)).tobytes() + runs.tobytes() + (rows["token"] >> np.uint64(32)).astype("<u4").tobytes()


def _posts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    runs = np.frombuffer(data, _RUN, n, 8)
    tokens = np.frombuffer(data, "<u4", -1, 8 + n * _RUN.itemsize)
    rows = np.empty(len(tokens), dtype=_POST)
    rows["token"], rows["group"], rows["n"] = tokens, np.repeat(runs["group"], runs["size"]), np.repeat(runs["n"], runs["size"])
    return rows


def _node_rows(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Packed node rows and their wide bitmaps."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    rows, at, wide = np.frombuffer(data, _NODE, n, 8), 8 + n * _NODE.itemsize, []
    for size in map(wide_bytes, rows["n"].tolist()):
        wide.append(data[at : at + size])
        at += size
    return rows, wide


def _postings(k: int, percent: int, buckets: int, order):
    """Rows (bucket, kind, data): packed postings (kind 0) and packed node rows (kind 1)."""

    def dealt(to):
        order_ = np.argsort(to, kind="stable")
        return [(int(to[i[0]]), i) for i in np.split(order_, np.flatnonzero(np.diff(to[order_])) + 1) if len(i)]

    def flush(posts, nodes, wide):
        out = []
        if posts:
            rows = np.concatenate(posts)
            out += [(b, 0, _post_bytes(rows[i])) for b, i in dealt((mix(rows["token"]) % np.uint64(buckets)).astype(np.int64))]
        if nodes:
            rows = np.array(nodes, dtype=_NODE)
            for b, i in dealt((mix(rows["key"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
                out.append((b, 1, np.int64(len(i)).tobytes() + rows[i].tobytes() + b"".join([wide[j] for j in i.tolist()])))
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(a, pa.int32()), "kind": pa.array(b, pa.int32()), "data": pa.array(c, pa.binary())})

    def run(batches):
        cells, seen, posts, nodes, wide, held = order.value, set(), [], [], [], 0
        for batch in batches:
            keys, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, _, buf, offs in chunks(batch.column(0)):
                for i, s in enumerate(shingle_sets(buf, offs, k), first):
                    known, n, node, group, bits = ids[i] is not None, len(s), 0, 0, NO_BITS
                    if n:
                        p = prefix_length(n, percent)
                        rank = cells[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                        prefix = s[np.lexsort((s, rank))[:p]]
                        node, group, bits = sequence_hash(s), sequence_hash(prefix, n), parity(s)
                        if group not in seen:
                            seen.add(group)
                            rows = np.empty(p, dtype=_POST)
                            rows["token"], rows["group"], rows["n"] = prefix, group, n
                            posts.append(rows)
                            held += p
                    nodes.append((keys[i], ids[i] if known else 0, known, n, node, group, bits))
                    wide.append(wide_parity(s))
            if held > PIECE:
                yield flush(posts, nodes, wide)
                posts, nodes, wide, held = [], [], [], 0
        yield flush(posts, nodes, wide)

    return run


def _lists(percent: int):
    """One bucket's postings to rows (kind, a, b, c, d): nodes (1: key, id, n, node, group, known), stars (2: group, group) and lists of three groups or more (3: list, group)."""

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        posts = [_posts(data[i].as_py()) for i, kind in enumerate(kinds) if kind == 0]
        pieces = [_node_rows(data[i].as_py()) for i, kind in enumerate(kinds) if kind == 1]
        nodes = np.concatenate([rows for rows, _ in pieces]) if pieces else np.zeros(0, dtype=_NODE)
        out = [[np.full(len(nodes), 1), nodes["key"], nodes["id"], nodes["n"], nodes["node"], nodes["group"], nodes["known"]]]
        if posts:
            p = np.concatenate(posts)
            # a stable pass by token keeps all else; only tokens in more than one posting go on
            p = p[np.argsort(p["token"], kind="stable")]
            same = p["token"][1:] == p["token"][:-1]
            p = p[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            p = p[np.lexsort((p["group"], p["n"], p["token"]))]
            if len(p):
                keep = np.ones(len(p), dtype=bool)
                keep[1:] = (p["token"][1:] != p["token"][:-1]) | (p["group"][1:] != p["group"][:-1]) | (p["n"][1:] != p["n"][:-1])
                p = p[keep]
                run_id = np.cumsum(np.concatenate(([True], p["token"][1:] != p["token"][:-1]))) - 1
                n = p["n"].astype(np.int64)
                place = run_id * (1 << 32) + n
                leader = np.searchsorted(place, run_id * (1 << 32) + (percent * n + 99) // 100)
                a, b = p["group"][leader], p["group"]
                stars = np.unique(np.stack([a, b], 1)[a != b], axis=0)
                z = np.zeros(len(stars), dtype=np.int64)
                out.append([z + 2, stars[:, 0], stars[:, 1], z, z, z, z])
                size = np.bincount(run_id)
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(size), dtype=np.uint64)
                    np.add.at(sums, run_id, mix(p["group"].astype(np.uint64)))
                names, where = np.unique(sums, return_index=True)  # equal lists once
                long = np.zeros(len(size), dtype=bool)
                long[where] = size[where] >= 3
                rows = long[run_id]
                z = np.zeros(int(rows.sum()), dtype=np.int64)
                out.append([z + 3, sums[run_id][rows].astype(np.int64), p["group"][rows], z, z, z, z])
        columns = {c: pa.array(np.concatenate([x[i] for x in out]).astype(np.int64)) for i, c in enumerate(("kind", "a", "b", "n", "node", "g", "known"))}
        rest = len(columns["kind"]) - len(nodes)
        bits = {f"bits{i}": pa.array(np.concatenate((nodes["bits"][:, i], np.zeros(rest, dtype=np.int64)))) for i in range(WORDS)}
        wide = [x or None for _, wides in pieces for x in wides] + [None] * rest
        return pa.table(columns | bits | {"wide": pa.array(wide, pa.binary())})

    return run


def packed(s: np.ndarray) -> bytes:
    """A set for shipping: its shingles in order, whole."""
    return s.astype("<u8").tobytes()


def unpacked(data) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _sets(k: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for first, _, buf, offs in chunks(batch.column(0)):
                sets = list(shingle_sets(buf, offs, k))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[first : first + len(sets)], pa.int64()), "set": pa.array([packed(s) for s in sets], pa.binary())})

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                s, t = unpacked(x[i].as_buffer()), unpacked(y[i].as_buffer())
                small, large = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep, pa.bool_())), b.filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The node pairs (a, b) whose sets link, by the sets themselves. nodes: (node, key); docs: (text, key)."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = small_side(settled(nodes.join(wanted, "node")))
    found = docs.join(wanted.select("key"), "key", "left_semi").select("text", "key")
    sets = found.mapInArrow(tidy(_sets(k)), "key long, set binary").join(wanted, "key").select("node", "set")
    left = pairs.join(sets, pairs["a"] == sets["node"]).select("a", "b", F.col("set").alias("x"))
    full = left.join(sets, left["b"] == sets["node"]).select("a", "b", "x", F.col("set").alias("y"))
    # rows that repeat a document may bring its set twice
    return settled(full.mapInArrow(tidy(_verify(percent)), "a long, b long").distinct())


def apart() -> str:
    """SQL for the differing bits of the sides a_ and b_ of a pair."""
    return " + ".join(f"bit_count(a_{b} ^ b_{b})" for b in BITS)


def can_link(percent: int) -> str:
    """SQL that a pair of sides a_ and b_ meets if its sets link: their sizes allow it, and no more bits differ than shingles of linked sets."""
    most = f"a_n + b_n - 2 * int(({percent} * (a_n + b_n) + {99 + percent}) / {100 + percent})"  # symmetric difference of two sets that link
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and {apart()} <= {most}"


def _wide(percent: int):
    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i) for i in range(6))
            keep = []
            for i, j, u, v in zip(n.to_pylist(), m.to_pylist(), x.to_pylist(), y.to_pylist()):
                keep.append(not u or not v or wide_apart(u, v) <= i + j - 2 * ((percent * (i + j) + 99 + percent) // (100 + percent)))
            yield pa.RecordBatch.from_arrays([z.filter(pa.array(keep, pa.bool_())) for z in (a, b)], names=["a", "b"])

    return run


def possible(pairs: DataFrame, nodes: DataFrame, percent: int, bits: bool = True) -> DataFrame:
    """The node pairs (a, b) that sizes and bitmaps do not rule out: the others are never shipped as sets. Without `bits`, by the wide bitmaps alone."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "wide", *(BITS if bits else ()))]), side)
    if bits:
        pairs = pairs.where(can_link(percent))
    return pairs.select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(tidy(_wide(percent)), "a long, b long")


def open_members(lists: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """(list, node, n, c, size, bits...) of the lists whose nodes lie in several components."""
    label = named.withColumnRenamed("component", "c")
    members = lists.join(nodes.select("g", "node", "n"), "g").join(label, "node", "left").select("list", "node", "n", F.coalesce("c", "node").alias("c"))
    wide = members.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("list", "size")
    return settled(members.join(wide, "list").join(nodes.select("node", *BITS), "node"))


def across(members: DataFrame, percent: int, block: int | None = None, nearest: bool = False, cell: int = BLOCK) -> DataFrame:
    """Node pairs (a, b) of one list and two components that could link.

    With `block`, a list is cut at random into blocks of about that many nodes and only pairs
    within a block are made: linear in the lists. Without it, all pairs are tried: a list of more
    than `cell` nodes is cut into blocks too, and each two blocks meet under a key of their own.
    With `nearest`, each node keeps the pair of least bound.
    """
    keys = ["list", "lo", "hi"]
    members = members.withColumn("blocks", F.ceil(F.col("size") / (block or cell)))
    members = members.withColumn("mine", F.pmod(F.xxhash64("node", "list"), "blocks"))
    if block:
        sides = dict.fromkeys("ab", members.withColumns({"lo": F.col("mine"), "hi": F.col("mine")}))
    else:
        sides = {"a": members.withColumn("lo", F.col("mine")).withColumn("hi", F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)))}
        sides["b"] = members.withColumn("hi", F.col("mine")).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mine"))))
    x, y = (df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "c", *BITS)]) for side, df in sides.items())
    can = f"(lo < hi or a_node < b_node) and a_c <> b_c and {can_link(percent)}"
    found = x.join(y, keys).where(can)
    if not nearest:
        return found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    found = found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.expr(apart()).alias("d"))
    one = found.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b")).unionByName(found.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")))
    return one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of xs with all of ys."""
    sides = [(np.repeat(np.arange(len(z)), [len(s) for s in z]), np.concatenate(z)) for z in (xs, ys)]
    shared = np.intersect1d(sides[0][1], sides[1][1])
    at = []
    for owner, token in sides:
        place = np.minimum(np.searchsorted(shared, token), max(len(shared) - 1, 0))
        there = shared[place] == token if len(shared) else np.zeros(len(token), dtype=bool)
        owner, place = owner[there], place[there]
        order = np.argsort(place, kind="stable")
        at.append((owner[order], place[order]))
    both = np.zeros((len(xs), len(ys)), dtype=np.int64)
    for base in range(0, len(shared), columns):
        part = []
        for (owner, place), z in zip(at, (xs, ys)):
            a, b = np.searchsorted(place, (base, base + columns))
            m = np.zeros((len(z), min(columns, len(shared) - base)), dtype=np.float32)
            m[owner[a:b], place[a:b] - base] = 1
            part.append(m)
        both += (part[0] @ part[1].T).astype(np.int64)
    return both


def _degrees(percent: int):
    """Rows (c, lo, hi, block, node, set) to (node, links): the links of the nodes of block lo to those of block hi, and back."""

    def run(t: pa.Table) -> pa.Table:
        c, lo, hi, block, node = (t.column(x).to_numpy() for x in ("c", "lo", "hi", "block", "node"))
        sets, names, links = t.column("set"), [], []
        order = np.lexsort((node, hi, lo, c))
        turns = np.flatnonzero((np.diff(c[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
        for rows in np.split(order, turns):
            # rows that repeat a document may bring its set twice
            rows = rows[np.unique(node[rows], return_index=True)[1]]
            x = rows[block[rows] == lo[rows]]
            y = rows[block[rows] == hi[rows]]
            if not len(x) or not len(y):
                continue
            xs = [unpacked(sets[int(i)].as_buffer()) for i in x]
            same = lo[rows[0]] == hi[rows[0]]
            ys = xs if same else [unpacked(sets[int(i)].as_buffer()) for i in y]
            both = common(xs, ys)
            linked = 100 * both >= percent * (np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])[None, :] - both)
            if same:
                np.fill_diagonal(linked, False)
            else:
                names.append(node[y])
                links.append(linked.sum(0))
            names.append(node[x])
            links.append(linked.sum(1))
        join = lambda z: pa.array(np.concatenate(z).astype(np.int64) if z else np.zeros(0, dtype=np.int64))
        return pa.table({"node": join(names), "links": join(links)})

    return run


def degrees(named: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, links) of the nodes of components of several nodes: all links, each pair compared by the sets once.

    named: (node, component); nodes: (node, key); docs: (text, key). Components of more than
    `block` nodes are cut into blocks, and each two blocks meet in a task of their own.
    """
    size = named.groupBy("component").agg(F.count("*").alias("size"))
    members = settled(named.join(size, "component").join(nodes, "node").select("node", "key", F.col("component").alias("c"), F.ceil(F.col("size") / block).alias("blocks"), "size"))
    pairs = members.where("size = 2").select("node", F.lit(1).cast("long").alias("links"))
    many = members.where("size > 2").drop("size")
    bins = many.count() // 2000 + 1
    many = small_side(many)
    found = docs.join(many.select("key"), "key", "left_semi").select("text", "key")
    sets = found.mapInArrow(tidy(_sets(k)), "key long, set binary").join(many, "key")
    rows = sets.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).select("node", "c", "set", "blocks", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("node", "c", "set", "blocks", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = rows.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("c"), F.lit(bins))).otherwise(F.xxhash64("c", "lo", "hi")))
    counted = rows.groupBy("bin").applyInArrow(_degrees(percent), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    return pairs.unionByName(counted)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, count_links: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per input row: (id, n_shingles, node, links, component_id).

    node names the class of equal sets (null without words), links counts the other nodes
    that the node links with (null if not asked for), component_id is the least id reachable.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select(F.col(text_col).alias("text"), row_key(docs, id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, int(size / 6 * (100 - percent) / 100 / PIECE) + 1)
    order = spark.sparkContext.broadcast(sketch(texts.select("text"), k))
    packed = texts.mapInArrow(tidy(_postings(k, percent, buckets, order)), "bucket int, kind int, data binary")
    rows = cut(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lists(percent), "kind long, a long, b long, n long, node long, g long, known long, " + ", ".join(f"{b} long" for b in BITS) + ", wide binary"))
    del packed
    release(spark)

    every = rows.where("kind = 1").select(F.col("a").alias("key"), F.when(F.col("known") == 1, F.col("b")).alias("id"), "n", "node", "g", *BITS, "wide")
    nodes = settled(every.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.min("key").alias("key"), F.min("id").alias("id"), *[F.first(b).alias(b) for b in (*BITS, "wide")]))
    leaders = nodes.groupBy("g").agg(F.min("node").alias("leader"), F.count("*").alias("size"))
    stars = rows.where("kind = 2").select("a", "b").distinct()
    lead = leaders.select("g", "leader")
    inner = nodes.select("g", "node").join(leaders.where("size > 1"), "g")
    first = stars.join(lead.withColumnsRenamed({"g": "a", "leader": "x"}), "a").join(lead.withColumnsRenamed({"g": "b", "leader": "y"}), "b").select("x", "y").unionByName(inner.where("node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y")))
    pairs = settled(possible(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), nodes, percent))
    key = nodes.select("node", "key")
    named = components(verified(pairs, key, texts, k, percent))
    release(spark)

    # lists that still hold several components: pairs across them, not tried before
    wide = inner.select("g").distinct()
    lists = rows.where("kind = 3").select(F.col("a").alias("list"), F.col("b").alias("g")).unionByName(
        stars.join(wide.withColumnRenamed("g", "a"), "a").unionByName(stars.join(wide.withColumnRenamed("g", "b"), "b").select("a", "b")).distinct().select(F.xxhash64("a", "b").alias("list"), F.explode(F.array("a", "b")).alias("g"))
    ).unionByName(wide.select(F.col("g").alias("list"), "g"))
    lists = settled(lists.distinct())
    for some, nearest in ((16, True), (None, True), (None, False)):
        members = open_members(lists, nodes, named)
        more = settled(possible(across(members, percent, some, nearest, block).join(pairs, ["a", "b"], "left_anti"), nodes, percent, bits=False))
        if more.isEmpty():
            continue
        found = verified(more, key, texts, k, percent)
        pairs = pairs.unionByName(more)
        # the new links join components: only these are followed
        label = named.withColumnRenamed("component", "c")
        ends = found.join(label.withColumnsRenamed({"node": "a", "c": "ca"}), "a", "left").join(label.withColumnsRenamed({"node": "b", "c": "cb"}), "b", "left")
        merged = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()).withColumnsRenamed({"node": "c", "component": "top"})
        every_node = named.unionByName(merged.select(F.col("c").alias("node"), F.col("c").alias("component"))).distinct()
        named = settled(every_node.join(merged, every_node["component"] == merged["c"], "left").select("node", F.coalesce("top", "component").alias("component")).distinct())

    full = nodes.join(named, "node", "left").select("node", "id", F.coalesce("component", "node").alias("c"))
    if count_links:
        full = full.join(degrees(named, key, texts, k, percent, block), "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    else:
        full = full.withColumn("links", F.lit(None).cast("long"))
    least = full.groupBy("c").agg(F.min("id").alias("component_id"))
    by_node = settled(full.join(least, "c").select("node", "links", "component_id"))
    linked = every.where("n > 0").join(small_side(by_node), "node").select("id", "n", "node", "links", "component_id")
    alone = every.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("node"), F.lit(0 if count_links else None).cast("long").alias("links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", "links", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component: that of the least id. Rows that share this id all stay, and so do rows without an id."""
    found = ngram_jaccard_join(docs, id_col, text_col, count_links=False)
    me = own("drop")
    drop = found.where(f"component_id <> `{id_col}`").select(F.col(id_col).alias(me)).distinct()
    return docs.join(drop, docs[id_col].cast("long") == drop[me], "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir):
    from .common import table

    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "links")
