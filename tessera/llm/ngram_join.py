"""N-gram Jaccard self-join of documents on word shingles, with count vectors and bounding boxes.

A document's set of shingles is a node; documents with equal sets share it, so copies cost one node. Shingles hash to
groups. Two numbers come from the groups:

* How often each of some total / 8 groups occurs over the whole corpus orders shingles, rare groups first. Two linked sets share one of
  their n - ceil(n * similarity) + 1 first shingles in any common order, so equal first shingles find every link.
* A node's counts in DIMENSIONS groups, or for sets of over 4 * DIMENSIONS in a quarter as many as the set has, are a
  point; groups of the larger number nest in those of the smaller. The overlap of two sets is at most the sum over coordinates of the
  smaller count.

A first shingle that several nodes have gathers them around its smallest node, the centre. A node keeps one row for each
of its centres, however many shingles led there, so a family of near copies stays a short table. Each node first meets
the centre it shares most with, by points and, if those allow a link, by sets; what links becomes one component. The members of a centre that still lie in several
components are sorted by component and size and cut into leaves of an R-tree, LEAF of them at most, with the upper
corner of their points. Pairs of leaves of one component, or whose corners or sizes cannot reach the overlap, are
dropped. The other pairs of leaves meet in a worker, twice: first with points alone, which leaves the members whose
point allows a link with another component; then those with their sets, where overlaps are counted exactly and only
links that join two components are given, at most one for each member of the two leaves. Pairs of members are never
rows.

A tree over all points alone prunes nothing: the counts of unrelated long texts differ less than a link allows (the
reason is in the README), so it works inside the families that first shingles make.

Defined results: as words count runs of characters other than [\\x20\\x09-\\x0D], A-Z in lower case. Null and empty
texts, and texts without words, have an empty set and are linked with nothing. Repeated rows are copies and get the
same component. Where a doc_id has several texts, each keeps its own set; components hold the smallest doc_id reached.
An empty table gives an empty result; other columns are not read by `components` and pass through `drop_near_copies`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from tessera.llm.common import Scratch
from tessera.llm.shingles import mix, set_hash, shingle_sets

PERCENT = 75  # a link: 100 * intersection >= PERCENT * union
MOST_BITS = 25
COUNTED = 1 << 22
TEXT_BYTES = 1 << 20
LINKS = 1 << 20
DIMENSIONS = 256
LEAF = 128
LEAF_BYTES = 1 << 19
SLICE = 1 << 13
LEAST_SLICES, MOST_SLICES = 16, 1024
CHUNK = 256


def prefix_length(n: int) -> int:
    """First shingles that a linked set must meet: n - ceil(0.75 * n) + 1."""
    return n - -(-PERCENT * n // 100) + 1


def least_overlap(a: int, b: int) -> int:
    """Smallest intersection of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _members(nodes: DataFrame) -> DataFrame:
    """(node, members) of every set, once for each task that met it."""
    return nodes.filter("members is not null").select("node", "members")


def _chunks(batch: pa.RecordBatch):
    for k in range(0, batch.num_rows, CHUNK):
        yield batch.slice(k, CHUNK)


def _texts(batch: pa.RecordBatch):
    """Slices of some TEXT_BYTES of text, since shingling takes some 50 bytes a byte; a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _point(values: np.ndarray) -> bytes:
    """How many shingles of a set fall in each group, held at 255."""
    bits = max(DIMENSIONS.bit_length() - 1, (len(values) - 1).bit_length() - 2)
    return np.minimum(np.bincount((mix(values) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, point, members): every document's set size, the hash of its set, its count vector and, with the
    first document of a task that has the set, the sorted hashes themselves. Texts are shingled here alone."""

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for b in _texts(whole):
                sets = shingle_sets(b.column(1))
                names = [set_hash(s) if len(s) else None for s in sets]
                members = []
                for s, node in zip(sets, names, strict=True):
                    members.append(None if node is None or node in seen else s.tobytes())
                    if node is not None:
                        seen.add(node)
                columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array([_point(s) if len(s) else None for s in sets], pa.binary()), pa.array(members, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "point", "members"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n long, node long, point binary, members binary")


def group_bits(total: int) -> int:
    """So many groups of shingles that eight fall in each on average, 2**MOST_BITS (32 MB of levels) at most."""
    return max(8, min(MOST_BITS, (total // 8).bit_length()))


def group_levels(nodes: DataFrame, bits: int) -> np.ndarray:
    """Per group of shingles its corpus count, on a logarithmic scale from 128 on; 2**bits bytes.

    Each task ships its counts in packed slices, which are summed slice by slice in as many tasks as the number of files
    asks for; the levels alone come to the driver."""
    size = 1 << bits
    slices = LEAST_SLICES
    while slices < min(MOST_SLICES, size, len(nodes.inputFiles()) // 4):
        slices *= 2
    step = size // slices

    def packed(held):
        at = np.concatenate(held).astype(np.int64)
        at.sort()
        ends = np.searchsorted(at, np.arange(slices + 1, dtype=np.int64) * step)
        counts = [np.minimum(np.bincount(at[ends[i] : ends[i + 1]] - i * step, minlength=step), 65535).astype(np.uint16) for i in range(slices)]
        return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())], ["slice", "counts"])

    def count(batches):
        held, n = [], 0
        for whole in batches:
            for b in _chunks(whole):
                for x in b.column(1):
                    s = np.frombuffer(x.as_buffer(), np.uint64)
                    held.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                    n += len(s)
                if n >= COUNTED:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(c.as_buffer()), np.uint16).astype(np.int64)
        out = [np.where(v < 128, v, np.minimum(255, 128 + 4 * np.log2(np.maximum(v, 128) / 128))).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(out, pa.binary())], ["slice", "levels"])

    counts = _members(nodes).mapInArrow(count, "slice int, counts binary")
    rows = counts.repartition(slices, "slice").mapInArrow(add, "slice int, levels binary").toLocalIterator()
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r[0] * step : (r[0] + 1) * step] = np.frombuffer(r[1], np.uint8)
    return out


def _blocks(nodes: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """(key, node, center, top): members of blocks of two nodes or more, each with the smallest node its task or bucket knew.

    Tasks meet equal keys themselves first and ship one node for them, so that a key reaches its bucket at most once
    from each task however many documents have it (top: the rows made there); their own members pass through dealt evenly."""
    held = nodes.sparkSession.sparkContext.broadcast(levels)
    bits = int(levels.size).bit_length() - 1

    def smallest(keys: np.ndarray, nodes: np.ndarray):
        """Sorted by key then node: unique keys, their smallest node, and the members of keys with several nodes."""
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[fresh], nodes[fresh]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, len(keys)))
        center = np.repeat(nodes[first], sizes)
        many = np.repeat(sizes > 1, sizes)
        return keys[first], nodes[first], keys[many], nodes[many], center[many]

    def ship(batches):
        seen: set[int] = set()
        keys, nodes = [], []
        for whole in batches:
            for b in _chunks(whole):
                for node, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if node in seen:
                        continue
                    seen.add(node)
                    s = np.frombuffer(x.as_buffer(), np.uint64)
                    rank = held.value[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(s) >> np.uint64(8)
                    k = prefix_length(len(s))
                    chosen = s[np.argpartition(rank, k - 1)[:k]]
                    keys.append(chosen)
                    nodes.append(np.full(k, node, np.int64))
        if not keys:
            return
        key, node, mk, mn, mc = smallest(np.concatenate(keys), np.concatenate(nodes))
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        blobs = [(int(bucket[p[0]]), False, np.column_stack([key[p].view(np.int64), node[p]]).tobytes()) for p in np.split(order, cuts)]
        for i in range(0, len(mk), 100_000):
            part = slice(i, i + 100_000)
            at = int(mix(np.array([mk[i] ^ np.uint64(i)], np.uint64))[0] % np.uint64(buckets))
            blobs.append((at, True, np.column_stack([mk[part].view(np.int64), mn[part], mc[part]]).tobytes()))
        for i in range(0, len(blobs), 64):
            part = blobs[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.bool_()), pa.array([x[2] for x in part], pa.binary())], ["bucket", "ready", "data"])

    def rows(key, node, center, top):
        for i in range(0, len(key), 100_000):
            part = [pa.array(x[i : i + 100_000], pa.int64()) for x in (key, node, center)]
            yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(part[0]), top))], ["key", "node", "center", "top"])

    def meet(batches):
        got: dict[int, list[np.ndarray]] = {}
        last = None
        for b in batches:
            for i, ready, data in zip(*(b.column(k) for k in range(3)), strict=True):
                data = np.frombuffer(data.as_buffer(), np.int64)
                if ready.as_py():
                    x = data.reshape(-1, 3)
                    yield from rows(x[:, 0].copy(), x[:, 1].copy(), x[:, 2].copy(), False)
                    continue
                i = i.as_py()
                if last is not None and i != last:
                    yield from joined(got.pop(last))
                got.setdefault(i, []).append(data.reshape(-1, 2))
                last = i
        if last is not None:
            yield from joined(got.pop(last))

    def joined(parts):
        x = np.concatenate(parts)
        _, _, mk, mn, mc = smallest(x[:, 0].copy(), x[:, 1].copy())
        yield from rows(mk, mn, mc, True)

    shipped = _members(nodes).mapInArrow(ship, "bucket int, ready boolean, data binary")
    return shipped.repartition(buckets, "bucket").sortWithinPartitions("ready", "bucket").mapInArrow(meet, "key long, node long, center long, top boolean")


def _stars(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, center, shared): every node once for each smallest node of a block it is in. A task's own centre gives way to its bucket's."""
    final = blocks.filter("top and node != center").select("key", F.col("node").alias("center"), F.col("center").alias("final")).distinct()
    own = blocks.filter("not top").join(final.hint("merge"), ["key", "center"], "left").select("node", F.coalesce("final", "center").alias("center"))
    every = own.union(blocks.filter("top").select("node", "center")).filter("node != center")
    return scratch.table(every.groupBy("node", "center").agg(F.count("*").alias("shared")), "stars")


def _involved(nodes: DataFrame) -> np.ndarray:
    """A bitmap of places in which the nodes of (node) fall: some 16 for each, 2**26 (8 MB) at most."""
    bits = min(26, max(16, (16 * nodes.count()).bit_length()))
    at = F.pmod("node", F.lit(1 << bits))
    words = nodes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {1 << bits}) & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out


def _sets(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members) of the nodes of `wanted` and a few others, each once, partitioned by node."""
    bitmap = _involved(wanted)
    held = nodes.sparkSession.sparkContext.broadcast(bitmap)
    places = bitmap.size * 64

    def run(batches):
        for whole in batches:
            for b in _chunks(whole):
                at = b.column(0).to_numpy() % places
                yield b.filter(pa.array((held.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    return _members(nodes).mapInArrow(run, "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))


@F.pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return pd.Series(out, dtype="bool")


@F.pandas_udf(BooleanType())
def _boxes_meet(high_a: pd.Series, high_b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """n, m: the smallest sizes in the two leaves. The overlap of any two points is at most the sum of the smaller upper corners."""
    out = []
    for ha, hb, i, j in zip(high_a, high_b, n, m, strict=True):
        bound = int(np.minimum(np.frombuffer(ha, np.uint16), np.frombuffer(hb, np.uint16)).sum(dtype=np.int64))
        out.append(bound >= least_overlap(i, j))
    return pd.Series(out, dtype="bool")


@F.pandas_udf(BooleanType())
def _points_fit(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    out = []
    for x, y, i, j in zip(a, b, n, m, strict=True):
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        if max(x.max(), y.max()) < 255:  # else it may stand for more and bounds nothing
            low = min(len(x), len(y))
            x, y = x.reshape(low, -1).sum(1, dtype=np.uint16), y.reshape(low, -1).sum(1, dtype=np.uint16)
            out.append(int(np.minimum(x, y).sum(dtype=np.int64)) >= least_overlap(i, j))
        else:
            out.append(True)
    return pd.Series(out, dtype="bool")


def _fitting(pairs: DataFrame, points: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sizes and points allow a link; at most one pair for each a."""
    one, two = (points.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"point_{x}")).hint("merge") for x in "ab")
    both = pairs.join(one, "a").join(two, "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return scratch.table(both.filter(_points_fit("point_a", "point_b", "n_a", "n_b")).select("a", "b"), "fitting")


def _verified(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The linked ones of (a, b). Both ends read one exchange; sets grow with the corpus and are never broadcast."""
    sets = _sets(nodes, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    out = scratch.table(both.filter(_linked("set_a", "set_b")).select("a", "b"), "links")
    scratch.settle()
    return out


def _forest(batches):
    """Every node of the links (a, b) of one task with the smallest node that these links join it to."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["node", "label"])


def connected(links: DataFrame, scratch: Scratch, each: int = LINKS) -> DataFrame:
    """(node, label): the smallest node of its component, for every node that a link (a, b) touches.

    Tasks of some `each` links contract them to trees of depth one. Trees of several tasks are joined by smallest
    neighbour labels with pointer jumping, each round a written table; rounds grow with the logarithm of the longest path."""
    tasks = max(1, -(-links.count() // each))
    links = links.select("a", "b")
    links = links.coalesce(1) if tasks == 1 else links.repartition(tasks)
    forest = scratch.table(links.mapInArrow(_forest, "node long, label long"), "forest")
    if tasks == 1:
        return forest
    links = forest.select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = scratch.table(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        least = scratch.table(least, "least")
        jumped = least.join(least.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"), "old")
        jumped = scratch.table(jumped, "labels")
        scratch.drop(least)
        scratch.drop(labels)
        labels = jumped.select("node", "label")
        if jumped.filter("label != old").isEmpty():
            return labels


def _labelled(blocks: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return blocks.withColumn("label", F.col("node"))
    return blocks.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


class Leaf:
    """Members of one centre: nodes, labels, sizes, points and, on end, their sets where they are carried."""

    def __init__(self, data):
        k, whole = (int(x) for x in np.frombuffer(data, np.int64, 2))
        head = np.frombuffer(data, np.int64, 4 * k, 16).reshape(4, k)
        self.nodes, self.labels, self.n, lengths = head[0], head[1].copy(), head[2], head[3]
        at = 16 + 32 * k
        flat = np.frombuffer(data, np.uint8, int(lengths.sum()), at)
        ends = np.cumsum(lengths)
        self.points = [(int(d), np.flatnonzero(lengths == d)) for d in np.unique(lengths)]
        self.points = [(d, which, np.stack([flat[ends[i] - d : ends[i]] for i in which])) for d, which in self.points]
        self.sets = np.frombuffer(data, np.uint64, int(self.n.sum()), at + len(flat)) if whole else None

    @staticmethod
    def pack(rows: list[tuple]) -> bytes:
        """Of (label, node, n, point, set or None)."""
        whole = rows[0][4] is not None
        head = np.array([len(rows), whole, *(r[1] for r in rows), *(r[0] for r in rows), *(r[2] for r in rows), *(len(r[3]) for r in rows)], np.int64)
        return head.tobytes() + b"".join(r[3] for r in rows) + (b"".join(r[4] for r in rows) if whole else b"")

    def fit(self, other: Leaf) -> np.ndarray:
        """Pairs of different components whose sizes and points allow a link."""
        n, m = self.n[:, None], other.n[None, :]
        out = (self.labels[:, None] != other.labels[None, :]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        need = -(-PERCENT * (n + m) // (100 + PERCENT))
        for d, here, p in self.points:
            for e, there, q in other.points:
                if not out[np.ix_(here, there)].any():
                    continue
                low = min(d, e)
                # A coordinate that reached its highest value may stand for more; it then bounds nothing.
                full = (p.max(1) == 255)[:, None] | (q.max(1) == 255)[None, :]
                a, b = (x if x.shape[1] == low else x.reshape(len(x), low, -1).sum(2, dtype=np.uint16) for x in (p, q))
                for i, row in zip(here, range(len(a)), strict=True):
                    js = np.flatnonzero(out[i, there])
                    if len(js):
                        bound = np.minimum(b[js], a[row]).sum(1, dtype=np.int64)
                        out[i, there[js]] = (bound >= need[i, there[js]]) | full[row, js]
        return out


def uniting_links(a: Leaf, b: Leaf) -> list[tuple[int, int]]:
    """Links between members of two leaves that join components, until no further link joins any."""
    fit = a.fit(b)
    ends = np.cumsum(a.n)
    index = None
    out = []
    for i in np.flatnonzero(fit.any(1)):
        some = np.flatnonzero(fit[i] & (b.labels != a.labels[i]))
        if not len(some):
            continue
        if index is None:
            order = np.argsort(b.sets, kind="stable")
            values, first = np.unique(b.sets[order], return_index=True)
            index = values, np.append(first, len(b.sets)), np.repeat(np.arange(len(b.n)), b.n)[order]
        values, first, owner = index
        n = a.n[i]
        mine = a.sets[ends[i] - n : ends[i]]
        at = np.searchsorted(values, mine)
        at[at == len(values)] = 0
        at = at[values[at] == mine]
        runs = first[at + 1] - first[at]
        hits = np.repeat(first[at] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        both = np.bincount(owner[hits], minlength=len(b.n))
        for j in some[100 * both[some] >= PERCENT * (n + b.n[some] - both[some])]:
            old, new = b.labels[j], a.labels[i]
            if old != new:
                b.labels[b.labels == old] = new
                a.labels[a.labels == old] = new
                out.append((int(a.nodes[i]), int(b.nodes[j])))
    return out


def _leaves(held: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves of the members (center, slice, label, n, node, point, members) of every centre, in order of component and
    size; a leaf is named by its first node. members is null where sets are not carried.

    A centre of many members is dealt in slices of some SLICE; each task sorts and cuts the slices it gets."""

    def corner(rows):
        low = [np.frombuffer(r[3], np.uint8).reshape(DIMENSIONS, -1) for r in rows]
        return np.stack([np.full(DIMENSIONS, 65535) if p.max() == 255 else p.sum(1, dtype=np.int64) for p in low]).max(0)

    def leaf(center, rows):
        labels, sizes = [r[0] for r in rows], [r[2] for r in rows]
        high = np.minimum(corner(rows), 65535).astype(np.uint16).tobytes()
        return (center, rows[0][1], labels[0] if min(labels) == max(labels) else None, min(sizes), max(sizes), high, Leaf.pack(rows))

    def cut(batches):
        def out():
            kind = [pa.int64()] * 5 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in ready], k) for i, k in enumerate(kind)], ["center", "leaf", "pure", "least", "most", "high", "data"])

        now, part, rows, size, ready = None, None, [], 0, []
        for whole in batches:
            for b in _chunks(whole):
                for center, piece, label, n, node, point, members in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                    if rows and (center != now or piece != part or len(rows) == LEAF or size > LEAF_BYTES):
                        ready.append(leaf(now, rows))
                        rows, size = [], 0
                    now, part = center, piece
                    rows.append((label, node, n, point, members))
                    size += len(point) + len(members or b"")
                    if len(ready) == LEAF:
                        yield out()
                        ready = []
        if rows:
            ready.append(leaf(now, rows))
        if ready:
            yield out()

    schema = "center long, leaf long, pure long, least long, most long, high binary, data binary"
    dealt = held.select("center", "slice", "label", "n", "node", "point", "members").repartition("center", "slice").sortWithinPartitions("center", "slice", "label", "n", "node")
    leaves = scratch.table(dealt.mapInArrow(cut, schema), "leaves")
    scratch.settle()
    return leaves


def _meeting(leaves: DataFrame, meet, schema: str, names: list[str], scratch: Scratch) -> DataFrame:
    """Distinct rows (long, long) of meet(leaf, leaf, centre) over all pairs of leaves that the boxes let through."""
    boxes = leaves.drop("data")
    other = boxes.select("center", *[F.col(c).alias(c + "_b") for c in ("leaf", "pure", "least", "most", "high")])
    near = boxes.join(other.hint("merge"), "center").filter(f"leaf <= leaf_b and coalesce(pure != pure_b, true) and 100 * most >= {PERCENT} * least_b and 100 * most_b >= {PERCENT} * least")
    near = near.filter(_boxes_meet("high", "high_b", "least", "least_b")).select("center", "leaf", "leaf_b")

    def run(batches):
        # At most the members that the task meets; a leaf comes with many others.
        given: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for c, left, right in zip(*(b.column(k) for k in range(3)), strict=True):
                for x in meet(Leaf(left.as_buffer()), Leaf(right.as_buffer()), c.as_py()):
                    if x not in given:
                        given.add(x)
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names)

    one = leaves.select("center", "leaf", F.col("data").alias("left"))
    two = leaves.select("center", F.col("leaf").alias("leaf_b"), F.col("data").alias("right"))
    met = near.join(one.hint("merge"), ["center", "leaf"]).join(two.hint("merge"), ["center", "leaf_b"]).select("center", "left", "right")
    out = scratch.table(met.mapInArrow(run, schema).distinct(), "met")
    scratch.settle()
    return out


def _alive(a: Leaf, b: Leaf, center: int) -> list[tuple[int, int]]:
    """(center, node) of the members whose point allows a link with another component."""
    fit = a.fit(b)
    return [(center, int(x)) for x in {*a.nodes[fit.any(1)], *b.nodes[fit.any(0)]}]


def _leaf_links(members: DataFrame, points: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that join components, of the members (center, slice, node, label) of every centre."""
    held = members.join(points.hint("merge"), "node").withColumn("members", F.lit(None).cast("binary"))
    alive = _meeting(_leaves(held, scratch), _alive, "center long, node long", ["center", "node"], scratch)
    members = scratch.table(members.join(alive.hint("merge"), ["center", "node"]), "alive")
    sets = _sets(nodes, members.select("node")).hint("merge")
    held = members.join(sets, "node").withColumn("n", (F.octet_length("members") / 8).cast("long"))
    held = held.withColumn("point", _points("members"))
    return _meeting(_leaves(held, scratch), lambda a, b, _: uniting_links(a, b), "a long, b long", ["a", "b"], scratch)


@F.pandas_udf(BinaryType())
def _points(members: pd.Series) -> pd.Series:
    return pd.Series([_point(np.frombuffer(m, np.uint64)) for m in members], dtype="object")


def node_links(nodes: DataFrame, scratch: Scratch, bits: int | None = None) -> DataFrame | None:
    """(node, label) of all nodes with a link; None when no two documents share a first shingle."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    levels = group_levels(nodes, bits or group_bits(total))
    buckets = max(24, total // 4_000_000)
    blocks = scratch.table(_blocks(nodes, levels, buckets), "blocks")
    scratch.settle()
    stars = _stars(blocks, scratch)
    scratch.drop(blocks)
    if stars.isEmpty():
        return None
    # Every node meets the centre it shares most with; what is still apart under a centre meets in leaves.
    best = scratch.table(stars.groupBy(F.col("node").alias("a")).agg(F.max_by("center", F.struct("shared", "center")).alias("b")), "best")
    points = scratch.table(nodes.filter("node is not null").select("node", "n", "point").dropDuplicates(["node"]), "points")
    links = _verified(_fitting(best, points, scratch), nodes, scratch)
    labels = connected(links, scratch)
    members = stars.join(best.select(F.col("a").alias("node"), F.col("b").alias("center"), F.lit(True).alias("met")), ["node", "center"], "left").select("center", "node", "met")
    members = members.union(stars.select("center", F.col("center").alias("node"), F.lit(True)).distinct())
    members = scratch.table(_labelled(members, labels), "members")
    # Two members that have met and are apart stay apart.
    open_ = members.groupBy("center").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.bool_and(F.coalesce("met", F.lit(False))).alias("met"))
    open_ = open_.filter("lo != hi and not (size = 2 and met)").select("center", F.expr(f"size div {SLICE} + 1").alias("slices"))
    members = scratch.table(members.join(open_, "center").select("center", F.expr("pmod(xxhash64(node), slices)").alias("slice"), "node", "label"), "apart")
    scratch.settle()
    if members.isEmpty():
        return labels
    more = _leaf_links(members, points, nodes, scratch)
    return connected(scratch.table(links.union(more), "links"), scratch)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, bits: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id) per document."""
    scratch = scratch or Scratch(docs.sparkSession)
    nodes = scratch.table(_nodes(docs, id_col, text_col), "nodes")
    labels = node_links(nodes, scratch, bits)
    sets = nodes.filter("node is not null").groupBy("node").agg(F.min("id").alias("first"))
    placed = _labelled(sets, labels)
    firsts = placed.groupBy("label").agg(F.min("first").alias("component"))
    placed = placed.join(firsts, "label").select("node", "component")
    out = nodes.join(placed, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with one row left of each component: the one whose id names it. Documents without words all stay."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(components(docs, id_col, text_col, scratch), "found")
    gone = scratch.table(found.filter(f"{id_col} != component_id").select(F.col(id_col).alias("__tessera_gone")).distinct(), "gone")
    scratch.settle()
    # The ids grow with the corpus: a merge join at every size, never a broadcast.
    gone = gone.hint("merge")
    kept = docs.join(gone, docs[id_col] == gone["__tessera_gone"], "left_anti")
    again = found.filter(f"n_shingles > 0 and {id_col} = component_id").groupBy(id_col).count().filter("count > 1")
    if again.isEmpty():
        return kept
    # Repeated rows of an id that stays: one of them.
    repeated = scratch.table(again.select(F.col(id_col).alias("__tessera_again")), "again")
    single = kept.join(repeated, kept[id_col] == repeated["__tessera_again"], "left_anti")
    several = kept.join(repeated, kept[id_col] == repeated["__tessera_again"], "left_semi")
    return single.unionByName(several.dropDuplicates([id_col]))
