"""Near-duplicate groups by an LSH forest over minhash signatures, with every link confirmed on the full shingle sets.

Documents with equal shingle sets are one node. Each of TREES orders sorts the nodes by signature values, its own first
DEPTH of them hashed into the partitioning key and the next ones behind. A region is a run with one prefix.

First, cheaply: neighbours in every order (all pairs of regions of up to NEIGHBOURS nodes) are candidates. Pairs whose signatures
agree in fewer than AGREE of the values are let go: at similarity 0.75 that has a chance below 1 in 100,000. Confirming has rounds:
each node's BEST most alike pairs, then all candidates that still lie between two components of what is linked.

Then, wholly: every region that still holds more than one component is compared, all nodes with all, by signatures, and nodes
that have an alike one in another component on their full sets; a task gives back only as many links as hold its nodes
together, and works on two blocks of CROWD nodes at most. That goes for regions with up to WHOLE * WHOLE pairs of a node outside the largest
component and any other. The depth of larger ones adapts to the shingles themselves: their nodes' full sets are put in one order, the rarest
shingle first, and a node joins a region for each of its first size - ceil(0.75 * size) + 1 shingles. Two sets of the wanted
similarity share one of these, so no link between them is lost, and a passage that many share comes last in the order. These
regions are compared in the same way, whatever their size.

At similarity 0.75 a pair shares no prefix of DEPTH values in any of the 24 trees with a chance of 2 in a million; of those that share
one, every link is found but for what the signature threshold lets go.

Components come from hooking every node to its smallest neighbour and contracting, in DataFrame operations; links, labels and
sets never go to the driver. A node is told by a 64-bit digest of its set, sets are compared as 48-bit numbers of their shingles.

Nulls and texts without words have no shingles and no links. A row without doc_id takes part, but names a component only
if no other row does (null). Repeated rows are copies. Rows are told apart by their sets alone, so equal doc_ids do no harm.
Ties of likeness go to the smaller nodes. A very long text is a step of its own. Only doc_id and text are read, so further
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BLANK_WORDS_LOWER, dropped, grams, lean, mixed, read, steps, unused, words, written

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, DEEPER, NEIGHBOURS, BEST = 24, 3, 4, 8, 2
VALUES = TREES * DEPTH
AGREE = int(VALUES * 0.75 - 5.4 * (VALUES * 0.75 * 0.25) ** 0.5)
HELD_ROWS, SET_BYTES, STEP = 1 << 20, 6, 4 << 20
CROWD, WHOLE, COLUMNS = 512, 16_384, 2048
_SEEDS = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64)).reshape(2, VALUES) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where they begin."""
    w = words(texts, BLANK_WORDS_LOWER)
    h = w.hashes()[w.codes]
    g = grams(h, SHINGLE)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for row, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
            sizes[row] = len(out[-1])
        elif b > a:
            out.append(mixed(grams(h[a:b], b - a) + np.uint64(b - a)))
            sizes[row] = 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """VALUES 32-bit minhashes of each set that is not empty."""
    full = starts[:-1][np.diff(starts) > 0]
    out = np.zeros((len(full), VALUES), np.uint32)
    for k in range(VALUES if len(full) else 0):
        x = (sets ^ _SEEDS[0, k]) * _SEEDS[1, k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), full) >> np.uint64(32)
    return out


def node(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, hash, n_shingles, node and signature (null without shingles) of each row of (doc_id, hash, text)."""
    lean()
    for batch in steps(batches, limit=STEP):
        sets, starts = shingle_sets(batch.column("text"))
        sizes = np.diff(starts)
        full = sizes > 0
        nodes = [node(sets[a:b]) if b > a else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        values = iter(signatures(sets, starts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(sizes), pa.array(nodes, pa.int64()), pa.array([next(values).tobytes() if f else None for f in full.tolist()], pa.binary())], names=["doc_id", "hash", "n_shingles", "node", "values"])


def planted_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, deep, deeper, node: a row of (node, values) in each tree's order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
        n = batch.column("node").to_numpy(zero_copy_only=False)
        for t in range(TREES):
            first = np.full(len(v), t, np.uint64)
            for k in range(DEPTH):
                first = mixed(first * np.uint64(0x9E3779B97F4A7C15) + v[:, t * DEPTH + k])
            rest = [v[:, ((t + 1) * DEPTH + k) % VALUES] for k in range(DEEPER)]
            columns = [first, (rest[0] << np.uint64(32)) | rest[1], (rest[2] << np.uint64(32)) | rest[3]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], names=["prefix", "deep", "deeper", "node"])


def _offers(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in sorted rows (prefix, deep, deeper, node)."""
    n = len(rows)
    left, right = [], []
    same = np.ones(n - 1, bool)
    lags = np.zeros((NEIGHBOURS, n), bool)
    for depth in range(3):
        same = same & (rows[1:, depth] == rows[:-1, depth])
        run = np.concatenate([[0], np.cumsum(~same)])
        size = np.bincount(run)[run]
        for lag in range(1, min(NEIGHBOURS, n)):
            near = run[lag:] == run[:-lag]
            lags[lag, : n - lag] |= near & ((size[:-lag] <= NEIGHBOURS) | (lag <= 2))
    for lag in range(1, min(NEIGHBOURS, n)):
        at = np.flatnonzero(lags[lag])
        left.append(rows[at, 3])
        right.append(rows[at + lag, 3])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: candidate pairs of a partition sorted by its columns. A region of over HELD_ROWS rows goes in parts that share two rows."""
    lean()
    held = np.zeros((0, 4), np.int64)

    def taken(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            a, b = _offers(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("prefix", "deep", "deeper", "node")], axis=1)
        held = np.concatenate([held, rows])
        if not len(held):
            continue
        last = int(np.searchsorted(held[:, 0], held[-1, 0], side="left"))  # where the last region, which may go on, begins
        if last:
            yield from taken(held[:last])
            held = held[last:]
        if len(held) > HELD_ROWS:
            yield from taken(held)
            held = held[-2:]
    yield from taken(held)


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size, members: the shingle set of each row of (text), as sorted numbers of SET_BYTES bytes."""
    lean()
    for batch in steps(batches, limit=STEP):
        sets, starts = shingle_sets(batch.column("text"))
        own = [sets[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if b > a]
        if own:
            cut = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :]).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([node(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(cut, pa.binary())], names=["node", "size", "members"])


def _members(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return wide.reshape(-1).view(np.uint64)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the rows (a, b, size_a, members_a, size_b, members_b) that are alike enough."""
    for batch in batches:
        keep, known, own = [], None, np.zeros(0, np.uint64)
        a, n_a, n_b = (batch.column(c).to_pylist() for c in ("a", "size_a", "size_b"))
        for row in range(batch.num_rows):
            if a[row] != known:
                known, own = a[row], _members(batch.column("members_a")[row].as_py())
            both = len(np.intersect1d(own, _members(batch.column("members_b")[row].as_py()), assume_unique=True))
            keep.append(100 * both >= PERCENT * (n_a[row] + n_b[row] - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def links(docs: DataFrame, pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked; owners(node, owner): a doc_id of each node."""
    sets = sets_for(docs, owners, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("members").alias("members_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("members").alias("members_a")), "a")
    return both.select("a", "b", "size_a", "members_a", "size_b", "members_b").mapInArrow(confirmed, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(a, b): the smallest node of its component."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels, used = None, [edges]
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
        hooks = written(hooks, "hooks")
        used.append(hooks)
        while True:  # each node to its root's root, until nothing changes
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            jumped = written(hooks.join(up, "root", "left").select("node", "root", F.coalesce("upper", "root").alias("upper")), "hooks")
            used.append(jumped)
            moving = not jumped.filter("upper <> root").isEmpty()
            hooks = jumped.select("node", F.col("upper").alias("root"))
            if not moving:
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            labels = labels.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        labels = written(labels, "labels")
        used.append(labels)
        to = lambda end: hooks.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))  # noqa: E731, B023
        edges = written(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), "edges")
        used.append(edges)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for table in used:
        if table is not labels:
            dropped(table)
    return labels


def _low(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint32).astype(np.uint8).reshape(-1, VALUES)


def near_others(group: pa.Table) -> pa.Table:
    """region, node of two blocks' rows (region, node, root, values) that agree enough with one of another component."""
    low, root = _low(group.column("values").to_pylist()), group.column("root").to_numpy()
    agree = np.zeros((len(low), len(low)), np.uint8)
    for k in range(VALUES):
        agree += low[:, k, None] == low[None, :, k]
    near = ((agree >= AGREE) & (root[:, None] != root[None, :])).any(axis=1)
    return group.select(["region", "node"]).filter(pa.array(near))


def crowd_links(group: pa.Table) -> pa.Table:
    """a, b: links between components of two blocks' rows (node, root, size, members), no more than hold the nodes together."""
    nodes, root, size = (group.column(c).to_numpy() for c in ("node", "root", "size"))
    n, row = len(nodes), np.repeat(np.arange(len(nodes)), size)
    _, code, times = np.unique(np.concatenate([_members(m.as_py()) for m in group.column("members")]), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((n, n), np.float32)
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [begin, begin + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[row[a:b], code[a:b] - begin] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    link = (100 * both >= PERCENT * (size[:, None] + size[None, :] - both)) & (root[:, None] != root[None, :])
    left, right, done = [], [], np.zeros(n, bool)
    for seed in range(n):
        reached = [] if done[seed] else [seed]
        done[seed] = True
        while reached:
            x = reached.pop()
            new = np.flatnonzero(link[x] & ~done)
            done[new] = True
            left += [x] * len(new)
            right += new.tolist()
            reached += new.tolist()
    a, b = nodes[np.array(left, np.int64)], nodes[np.array(right, np.int64)]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows(region, node, root, ..) once for each group of two blocks that has its own: part, left and right tell the group.

    Nodes of a region's largest component (root) are only compared with the others: part 0 has one block of each. Part 1 has
    two blocks of others. So a region that is nearly one component goes in about as many rows as it has nodes.
    """
    sizes = rows.groupBy("region", "root").agg(F.count("*").alias("n")).groupBy("region").agg(F.max(F.struct("n", "root")).alias("_top"), F.sum("n").alias("_all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / CROWD)).cast("int")
    sizes = sizes.select("region", F.col("_top.root").alias("_root"), blocks(F.col("_top.n")).alias("_main"), blocks(F.col("_all") - F.col("_top.n")).alias("_others"), (F.col("_all") <= CROWD).alias("_small"))
    x = rows.join(sizes, "region").withColumn("_is", F.col("root") == F.col("_root"))
    x = x.withColumn("_own", F.when(F.col("_small"), 0).otherwise(F.pmod(F.hash("node"), F.when(F.col("_is"), F.col("_main")).otherwise(F.col("_others")))))
    group = lambda part, left, right: F.struct(F.lit(part).alias("part"), left.alias("left"), right.alias("right"))
    other = F.sequence(F.lit(0), F.col("_others") - 1)
    main = F.transform(other, lambda o: group(0, o, F.col("_own")))
    against = F.transform(F.sequence(F.lit(0), F.col("_main") - 1), lambda m: group(0, F.col("_own"), m))
    among = F.transform(F.filter(other, lambda o: o != F.col("_own")), lambda o: group(1, F.least(o, F.col("_own")), F.greatest(o, F.col("_own"))))
    one = F.array(group(0, F.lit(0), F.lit(0)))
    places = F.when(F.col("_small"), one).when(F.col("_is"), main).otherwise(F.concat(against, among))
    return x.select(*rows.columns, F.inline(places))


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, root of rows (node, root, values): one key for each tree, of its first DEPTH values."""
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, VALUES)
        for t in range(TREES):
            key = np.full(len(v), t, np.uint64)
            for k in range(DEPTH):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[:, t * DEPTH + k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("node"), batch.column("root")], names=["key", "node", "root"])


def _mixed(rows: DataFrame) -> DataFrame:
    """key, n, others of the keys whose rows(key, node, root) have several roots: how many nodes, and how many outside the largest component; of keys with the same nodes one."""
    roots = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("whose"))
    keys = roots.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.bit_xor("whose").alias("whose"), F.count("*").alias("roots"))
    several = keys.filter("roots > 1").groupBy("whose", "n").agg(F.min(F.struct("key", (F.col("n") - F.col("top")).alias("others"))).alias("k"))
    return several.select("k.key", "n", "k.others")


def regions(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """region, node, root of the regions of labelled(node, root, values) with several components; and node of those that are too large to be compared."""
    rows = written(labelled.mapInArrow(keyed, "key long, node long, root long"), "keyed")
    sizes = written(_mixed(rows), "sizes")
    fits = F.col("n").cast("double") * F.col("others") <= float(WHOLE) ** 2
    found = written(rows.join(sizes.filter(fits).select("key"), "key").select(F.col("key").alias("region"), "node", "root"), "regions")
    large = written(rows.join(sizes.filter(~fits).select("key"), "key").select("node").distinct(), "large")
    dropped(rows)
    dropped(sizes)
    return found, large


def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size, key of rows (node, size, members): one for each shingle."""
    for batch in batches:
        for k in range(0, batch.num_rows, CROWD):
            part = batch.slice(k, CROWD)
            own, size = np.concatenate([_members(m) for m in part.column("members").to_pylist()] or [np.zeros(0, np.int64)]), part.column("size").to_numpy()
            at = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([part.column("node").take(at), part.column("size").take(at), pa.array(own.astype(np.int64))], names=["node", "size", "key"])


def rare_regions(docs: DataFrame, nodes: DataFrame, labelled: DataFrame, large: DataFrame) -> DataFrame:
    """region, node, root: for each of the large nodes the shingles of which two alike sets share one, the rarest first, as regions with several components."""
    every = written(sets_for(docs, nodes, large).mapInArrow(shingles_of, "node long, size long, key long"), "shingles")
    shared = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Shingles of one node are its rarest: they take the first places and join it to nothing.
    own = every.join(shared, "key").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    first = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1 - (F.col("size") - F.size("keys"))
    prefix = own.select("node", F.explode(F.slice("keys", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("k")).select("node", F.col("k.key").alias("key"))
    rows = written(prefix.join(labelled.select("node", "root"), "node").select("key", "node", "root"), "prefixes")
    found = written(rows.join(_mixed(rows).select("key"), "key").select(F.col("key").alias("region"), "node", "root"), "regions")
    dropped(every)
    dropped(rows)
    return found


def sets_for(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, size, members of the wanted(node), from one text of each."""
    owners = wanted.select("node").distinct().join(nodes.select("node", "owner"), "node").select(F.col("owner").alias("_owner")).distinct()
    texts = docs.select("doc_id", "text").join(owners, F.col("doc_id").eqNullSafe(F.col("_owner")), "left_semi").select("text")
    return texts.mapInArrow(sets_of, "node long, size long, members binary").dropDuplicates(["node"])


def compared(docs: DataFrame, nodes: DataFrame, labelled: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: links between the components of labelled(node, root, values), of all pairs of nodes that share a region of rows(region, node, root)."""
    near = _in_blocks(rows).join(labelled.select("node", "values"), "node").select("region", "part", "left", "right", "node", "root", "values")
    near = written(near.groupBy("region", "part", "left", "right").applyInArrow(near_others, "region long, node long").distinct(), "near")
    full = _in_blocks(near.join(labelled.select("node", "root"), "node")).join(sets_for(docs, nodes, near), "node")
    full = full.select("region", "part", "left", "right", "node", "root", "size", "members").groupBy("region", "part", "left", "right").applyInArrow(crowd_links, "a long, b long")
    full = written(full.distinct(), "links")
    dropped(near)
    return full


def crowded(docs: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: links between the components (node, root) found so far, of all pairs of nodes that share a region."""
    labels = nodes.select("node", "values").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "values")
    labelled = written(labels, "labelled")
    rows, large = regions(labelled)
    found = compared(docs, nodes, labelled, rows)
    dropped(rows)
    if not large.isEmpty():
        rare = rare_regions(docs, nodes, labelled, large)
        found = found.unionByName(compared(docs, nodes, labelled, rare))
        dropped(rare)
    dropped(large)
    dropped(labelled)
    return found


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b, agree: offered pairs of nodes(node, values) and the number of signature values in which they agree."""
    trees = nodes.select("node", "values").mapInArrow(planted_trees, "prefix long, deep long, deeper long, node long")
    order = trees.repartition("prefix").sortWithinPartitions("prefix", "deep", "deeper", "node")
    pairs = order.mapInArrow(offered, "a long, b long").distinct()

    def low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(v, np.uint32).astype(np.uint8).tobytes() for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(low, pa.binary())], names=["node", "low"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, VALUES) for c in ("low_a", "low_b"))
                agree = (x == y).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree)], names=["a", "b", "agree"]).filter(pa.array(agree >= AGREE))

    low = nodes.select("node", "values").mapInArrow(low_bytes, "node long, low binary")
    a, b = (low.select(F.col("node").alias(end), F.col("low").alias(f"low_{end}")) for end in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "low_a", "low_b").mapInArrow(weighed, "a long, b long, agree int")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, root, component_id for each row of docs(doc_id, text); root tells components, null: no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(described, f"doc_id {kind}, hash long, n_shingles long, node long, values binary"), "described")
    nodes = written(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("owner"), F.first("values").alias("values")), "nodes")
    rows_out = written(rows.drop("values"), "rows")
    dropped(rows)
    pairs = written(candidates(nodes), "pairs")
    ends = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
    best = ends.withColumn("_rank", F.row_number().over(W.partitionBy("end").orderBy(F.desc("agree"), "a", "b"))).filter(F.col("_rank") <= BEST)
    best = written(best.select("a", "b").distinct(), "best")
    found = written(links(docs, best, nodes.select("node", "owner")), "links")
    roots = components(found)
    to = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(to("a"), "a", "left").join(to("b"), "b", "left")
    rest = written(apart.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"), "rest")
    dropped(pairs)
    dropped(best)
    if not rest.isEmpty():
        found = found.unionByName(written(links(docs, rest, nodes.select("node", "owner")), "links"))
        roots = components(found)
    dropped(rest)
    more = crowded(docs, nodes, roots)
    if not more.isEmpty():
        roots = components(found.unionByName(more))
    named = nodes.select("node", "owner").join(roots, "node", "left").select("node", "owner", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = written(named.join(names, "root").select("node", "root", "component_id"), "named")
    dropped(nodes)
    out = rows_out.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "hash", "n_shingles", "root", component.alias("component_id"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return members(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def survivors(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id (none: last, then the smallest text hash), and all without words; columns stay."""
    key, hash_ = unused(docs, "_gone", "_hash")
    rows = written(members(docs.select("doc_id", "text")).select("doc_id", "hash", "root"), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(rank).alias("b")).select("root", "b.doc_id", "b.hash")
    own = rows.filter(F.col("root").isNotNull()).groupBy("doc_id", "hash").agg(F.first("root").alias("root"), F.count("*").alias("n"))
    own = written(own.join(best.withColumnRenamed("doc_id", "_d").withColumnRenamed("hash", "_h"), "root").select("doc_id", "hash", "n", (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("hash") == F.col("_h"))).alias("stays")), "fates")
    gone = own.filter("not stays").select(F.col("doc_id").alias(key), F.col("hash").alias(hash_))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
    return kept if own.filter("stays and n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])  # only then are there repeated rows


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(read(spark, sf_dir, "documents"))
