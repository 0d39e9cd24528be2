"""Near-duplicate documents by a chosen-path set similarity join (operator 7).

Sets of word shingles are sketched by SKETCH minwise tokens. In each of TREES
independent trees a document branches, at every node, along the few tokens that
a hash of the node's path selects (1 / similarity of them on average) into the
children of their values. Two levels are made in the scan; a node that leaves
too many pairs to compare branches on in Spark, to DEPTH at most. Two documents
at the very threshold share a node of level 2 in some tree but for a chance of
3e-7, and one of level DEPTH but for 1e-4 (TREES is chosen for that). How deep
a node branches depends on its size, so between these two figures lies the
chance to miss a pair; two looks at the sketches add 1e-7 each (MISSED). More
similar pairs are missed less, and a link is lost only if no chain of others replaces it.

Nodes are compared in two steps, so that groups of alike texts of any size take
few comparisons. First every document is compared to the least member of its
nodes and to the most central one (whose own nodes have the most members), on
full sets; linked ones form classes. Then the nodes that
still hold several classes are compared exhaustively across classes, on sketches
and then on full sets: the members outside a node's largest class with each
other, and, once for all nodes with the same largest class, with its members. A
group gives no more links than it has members. What has more than LIMIT members,
or full sets of more than ITEMS shingles, is dealt out in blocks, so a task
holds two blocks at most; hot nodes, pivots and hubs are dealt out by salts. A
node with more than BRANCH members outside its largest class branches on.

Texts with one and the same set are one member from the start. Nulls: a null or
empty text has no shingles, links to nothing and has its own id as component; a
null doc_id takes no part in the choice of the least id. Repeated rows are kept
in the operator; the pipeline's stage keeps one. Ties: the least doc_id stands
for its component. An empty table gives an empty one; columns other than doc_id
and text, whatever their names, are not looked at and pass through the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components

SKETCH = 128
TREES = 24
#: Members that are compared at once; larger sets of them are dealt out in blocks.
LIMIT = 300
#: Shingles (8 bytes each) of the full sets in a block, but for a set that has more by itself.
ITEMS = 1_000_000
#: A node branches on if more members than this are outside its largest class; to DEPTH levels at most.
BRANCH = 2_000
DEPTH = 4
#: Members of a task that compares.
TASK_MEMBERS = 4_000

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)
_PICK = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)


def shingle_hashes(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): row r has hashes[first[r]:first[r + 1]], repeats included; under k words, all of them make one."""
    data = tk.LOWER[raw]
    starts, ends, at = tk.word_spans(data, bounds, tk.SOLID)
    words = tk.span_hashes(data, starts, ends)
    sizes = np.diff(at)
    grams = tk.gram_hashes(words, k)
    whole = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    first = np.zeros(len(at), np.int64)
    np.cumsum(whole, out=first[1:])
    row = np.repeat(np.arange(len(sizes)), whole)
    index = at[:-1][row] + np.arange(len(row)) - first[row]
    out = np.zeros(len(row), np.uint64)
    long = sizes[row] >= k
    out[long] = grams[index[long]]
    for m in range(1, k):
        short = sizes[row] == m
        if short.any():
            out[short] = tk.gram_hashes(words, m)[index[short]]
    return out, first


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH least 32-bit values of each row that has hashes (rows without get zeros)."""
    n = len(first) - 1
    out = np.zeros((n, SKETCH), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        for i in range(SKETCH):
            v = ((hashes * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32)
            out[full, i] = np.minimum.reduceat(v, first[full])
    return out


def _root_tokens(similarity: float) -> list[tuple[int, int]]:
    """(tree, token) pairs: each token branches at a tree's root with probability 1 / (similarity * SKETCH)."""
    draws = np.random.default_rng(2018).random((TREES, SKETCH)) < 1 / (similarity * SKETCH)
    return [(t, i) for t in range(TREES) for i in (np.flatnonzero(draws[t]) if draws[t].any() else [t % SKETCH])]


def paths(values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the nodes at the second level."""
    bound = np.uint64(int(2**64 / (similarity * SKETCH)))
    rows, nodes = [], []
    for tree, i in _root_tokens(similarity):
        path = tk.mix(values[:, i].astype(np.uint64) * np.uint64(SKETCH) + np.uint64(i) + (np.uint64(tree + 1) << np.uint64(40)))
        taken = tk.mix(path[:, None] + _PICK[None, :]) < bound
        taken[:, i] = False
        r, j = np.nonzero(taken)
        rows.append(r)
        nodes.append(tk.mix(path[r] ^ tk.mix(values[r, j].astype(np.uint64) * np.uint64(SKETCH) + j.astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(nodes)


def _identity(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two independent hashes of a set of hashes."""
    n = np.uint64(len(own))
    return tk.mix(tk.mix(own).sum(dtype=np.uint64, keepdims=True) + n)[0], tk.mix(own ^ np.uint64(0x1234567)).sum(dtype=np.uint64)


_SCAN = "doc_id bigint, text_key bigint, n_shingles bigint, a bigint, b bigint, sketch binary, paths array<bigint>"


def _scan(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, bounds in tk.text_chunks(batch.column("text")):
                hashes, first = shingle_hashes(raw, bounds, k)
                n, a, b = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                for r in range(hi - lo):
                    own = np.unique(hashes[first[r] : first[r + 1]])
                    n[r] = len(own)
                    a[r], b[r] = _identity(own)
                values = minima(hashes, first)
                rows, nodes = paths(values, similarity)
                full = n[rows] > 0
                rows, nodes = rows[full], nodes[full]
                order = np.lexsort((nodes, rows))
                rows, nodes = rows[order], nodes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (nodes[1:] != nodes[:-1])
                rows, nodes = rows[new], nodes[new]
                low = (values & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), batch.column("text_key").slice(lo, hi - lo), pa.array(n), pa.array(tk.signed(a)), pa.array(tk.signed(b)),
                        pa.array([x.tobytes() for x in low], pa.binary()), tk.list_array(pa.array(tk.signed(nodes)), np.bincount(rows, minlength=hi - lo)),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "a", "b", "sketch", "paths"],
                )

    return run


def full_sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rid, items (sorted shingle hashes) of wanted (rid, doc_id, text_key; a stored table): a document that has the set.

    Only the texts of documents that a broadcast bit table marks leave the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, bounds in tk.text_chunks(batch.column("text")):
                hashes, first = shingle_hashes(raw, bounds, k)
                sets = [np.unique(hashes[first[r] : first[r + 1]]) for r in range(hi - lo)]
                rids = np.array([_identity(x)[0] for x in sets], np.uint64)
                items = tk.list_array(pa.array(np.concatenate(sets).view(np.int64)), np.array([len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(rids)), items], names=["rid", "items"])

    some, _ = tk.parts(spark, docs.select("doc_id", "text"), wanted)
    sets = tk.keyed_texts(some).mapInArrow(tk.released(run), "rid bigint, items array<bigint>")
    return sets.join(tk.merged(wanted.select("rid")), "rid", "left_semi").dropDuplicates(["rid"])


def _similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


#: The chance that either look at the sketches drops a pair at the threshold; it is the same in all trees.
MISSED = 1e-7
#: Pairs of members whose sketches are compared at once.
_PAIRS = 1 << 18
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Members by group, never a part of a group, from batches in the order of groups; in a group those of side 1 come first."""
    left = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if left is None else pa.concat_tables([left, part])
        group = part.column("group").to_numpy()
        if len(group):
            cut = int(np.flatnonzero(np.append(True, group[1:] != group[:-1]))[-1])
            left = part.slice(cut)
            if cut:
                yield part.slice(0, cut)
    if left is not None and len(left):
        yield left


def _agreeing(sketch: np.ndarray, x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """In how many of the first 8 * words bytes sketches x and y agree."""
    differ = sketch[x, :words] ^ sketch[y, :words]
    return 8 * words - np.bitwise_count((((differ & _LOW) + _LOW) | differ) & _HIGH).sum(axis=1, dtype=np.int64)


@cache
def _least(percent: int, n: int) -> int:
    """Agreements that a pair at the threshold has in n places, but for a chance of MISSED."""
    p, at_most, t = percent / 100, 0.0, 0
    while (at_most := at_most + math.comb(n, t) * p**t * (1 - p) ** (n - t)) <= MISSED:
        t += 1
    return t


def _pairs(part: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, places in which their sketches agree) of rows of one group and different classes, and sides if there are any, that may be similar."""
    group, classes, side = (part.column(c).to_numpy() for c in ("group", "cls", "side"))
    sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u8").reshape(len(part), SKETCH // 8)
    row = np.arange(len(part))
    new = np.append(True, group[1:] != group[:-1])
    number = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(part))[number]
    ones = np.bincount(number, weights=side == 1).astype(np.int64)[number]
    # a row meets those after it, or, of two sides, a row of side 1 the rows of side 0, which come last
    begin = np.where(side == 1, np.flatnonzero(new)[number] + ones, np.where(side == 0, end, row + 1))
    count = end - begin
    found = [[np.zeros(0, np.int64)] * 3]
    lo, upto = 0, np.concatenate([[0], np.cumsum(count)])
    while lo < len(part):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PAIRS, side="right")) - 1)
        x = np.repeat(row[lo:hi], count[lo:hi])
        y = begin[x] + np.arange(len(x)) - np.repeat(upto[lo:hi] - upto[lo], count[lo:hi])
        keep = classes[x] != classes[y]
        x, y = x[keep], y[keep]
        for words in (4, SKETCH // 8):  # most are told apart by a quarter of their sketches
            agree = _agreeing(sketch, x, y, words)
            keep = agree >= _least(percent, 8 * words)
            x, y, agree = x[keep], y[keep], agree[keep]
        found.append([x, y, agree])
        lo = hi
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _likely(percent: int):
    """The members of a group with a likely partner in another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches):
            x, y, _ = _pairs(part, percent)
            yield from part.take(pa.array(np.unique(np.concatenate([x, y])))).select(["rid", "cls", "group", "side", "sketch", "size"]).to_batches()

    return run


def _across(percent: int):
    """Links between classes of one group: exact on full sets, pairs with like sketches first, none between classes already joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches):
            group, rids, classes = (part.column(c).to_numpy() for c in ("group", "rid", "cls"))
            items = part.column("items").combine_chunks()
            bounds, values = items.offsets.to_numpy(), items.values.to_numpy()
            x, y, agree = _pairs(part, percent)
            out, parent, now = [], {}, None

            def root(c: int) -> int:
                while parent.get(c, c) != c:  # noqa: B023
                    c = parent[c]  # noqa: B023
                return c

            for i in np.lexsort((rids[y], rids[x], -agree, group[x])):
                a, b = int(x[i]), int(y[i])
                if group[a] != now:
                    parent, now = {}, group[a]
                p, q = root(int(classes[a])), root(int(classes[b]))
                if p != q:
                    one, two = values[bounds[a] : bounds[a + 1]], values[bounds[b] : bounds[b + 1]]
                    if _similar(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), percent):
                        parent[max(p, q)] = min(p, q)
                        out.append((int(rids[a]), int(rids[b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], names=["a", "b"])

    return run


def _nodes(steps: tk.Steps, level: DataFrame) -> DataFrame:
    """rid, node, n, low of the nodes (rid, node) with two members or more: their number and least member."""
    nodes = steps.store(level.groupBy("node").agg(F.count("*").alias("n"), F.min("rid").alias("low")).where("n > 1"))
    out = steps.store(tk.skew_join(level, nodes, nodes.select("node", "n"), ["node"]))
    steps.drop(nodes)
    return out


def _children(members: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """rid, node one level below, along the tokens that a hash of each node selects."""
    picks = F.array(*[F.lit(int(x)) for x in _PICK.view(np.int64)])
    bound = int(2**63 / (similarity * SKETCH))
    taken = F.filter(F.transform(picks, lambda p, i: F.struct((F.shiftrightunsigned(F.xxhash64("node", p), 1) < bound).alias("on"), i.alias("i"))), lambda x: x["on"])
    below = members.join(tk.merged(reps.select("rid", "sketch")), "rid").select("rid", "node", "sketch", F.explode(taken).alias("t"))
    return below.select("rid", F.xxhash64("node", "t.i", F.substring("sketch", F.col("t.i") + 1, F.lit(1))).alias("node"))


def _crossed(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """rid, cls, group, side, sketch, size of members (rid, cls, main, sketch, size; distinct): blocks of a main class against blocks of the members that met it."""
    minor = F.col("cls") != F.col("main")
    dealt = tk.skew_join(members, sizes, sizes, ["main"])
    dealt = dealt.withColumn("nb", F.ceil((F.col("n") - F.col("rest")) / LIMIT).cast("int")).withColumn("ns", F.ceil(F.col("rest") / LIMIT).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rid"), F.when(minor, F.col("ns")).otherwise(F.col("nb"))).cast("int"))
    crossed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("nb")).otherwise(F.col("ns")) - 1)))
    group = F.xxhash64("main", F.when(minor, F.col("own")).otherwise(F.col("other")), F.when(minor, F.col("other")).otherwise(F.col("own")))
    return crossed.select("rid", "cls", group.alias("group"), minor.cast("int").alias("side"), "sketch", "size")


def _dealt(members: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """members (rid, cls, group, side, sketch, size) with groups of more than limit (sizes: group, total, n rows) dealt out in blocks; any two members meet in one of the new groups."""
    parted = tk.skew_join(members, sizes.select("group", "total"), sizes.select("group", "n"), ["group"]).withColumn("nb", F.ceil(F.col("total") / limit).cast("int"))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("rid", F.lit("own")), F.col("nb")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    group = F.when(F.col("nb") == 1, F.col("group")).otherwise(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
    return parted.select("rid", "cls", group.alias("group"), "side", "sketch", "size")


def _spread(members: DataFrame, n: int) -> DataFrame:
    """members partitioned by group and in its order, in as many tasks as n of them are worth: comparing costs time, not bytes."""
    return members.repartition(max(1, -(-n // TASK_MEMBERS)), "group").sortWithinPartitions("group", F.desc("side"), "rid")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component (a number of its own for each) of every row; linked: shared shingles are percent of all, at least. A stored table."""
    similarity = percent / 100
    with tk.Steps(spark) as steps:
        base = steps.store(tk.keyed_texts(docs).mapInArrow(tk.released(_scan(k, similarity)), _SCAN))
        reps = base.where("n_shingles > 0").groupBy(F.col("a").alias("rid"), "b").agg(
            F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("n_shingles").alias("size"), F.count("*").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")
        )
        reps = steps.store(reps.select("rid", "low", "size", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key"), "sketch", "paths"))
        rows = steps.store(base.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("a")).alias("a")))
        steps.drop(base)

        # every document against the least and the most central one of its nodes
        here = _nodes(steps, reps.select("rid", F.explode("paths").alias("node")))
        met = steps.store(reps.select("rid", "doc_id", "text_key").join(tk.merged(here.select("rid").distinct()), "rid", "left_semi"))
        sets = steps.store(full_sets(spark, docs, met, k))
        central = here.join(tk.merged(here.groupBy("rid").agg(F.sum("n").alias("near"))), "rid").groupBy("node").agg(F.max(F.struct("near", "rid"))["rid"].alias("central"), F.first("n").alias("n"))
        central = steps.store(central)
        stars = tk.skew_join(here, central.select("node", "central"), central.select("node", "n"), ["node"]).select("rid", F.explode(F.array("low", "central")).alias("pivot")).where("rid <> pivot").groupBy("rid", "pivot").count().where("count > 1").select("rid", "pivot")
        stars = steps.store(stars)
        pivots = steps.store(stars.groupBy("pivot").agg(F.count("*").alias("n")))
        others = sets.join(tk.merged(pivots.select(F.col("pivot").alias("rid"))), "rid", "left_semi").select(F.col("rid").alias("pivot"), F.col("items").alias("others"))
        linked = tk.skew_join(sets.join(tk.merged(stars), "rid"), others, pivots, ["pivot"]).where(_similar(F.size(F.array_intersect("items", "others")), F.size("items"), F.size("others"), percent))
        linked = steps.store(linked.select(F.col("rid").alias("a"), F.col("pivot").alias("b")))
        steps.drop(met, stars, pivots, central)
        classes = components(spark, linked).withColumnRenamed("node", "rid")

        # of the nodes that still hold several classes, those where too much is outside the largest one branch on
        mains, rests, done, depth = [], [], [], 2
        while True:
            leaves = steps.store(here.select("rid", "node").join(tk.merged(classes), "rid", "left").select("rid", "node", F.coalesce("root", "rid").alias("cls")))
            counts = leaves.groupBy("node", "cls").count()
            main = counts.groupBy("node").agg(F.max(F.struct("count", "cls")).alias("m"), F.sum("count").alias("n"), F.count("*").alias("classes")).where("classes > 1")
            main = steps.store(main.select("node", F.col("m.cls").alias("main"), "n", (F.col("n") - F.col("m.count")).alias("rest")))
            held = steps.store(tk.skew_join(leaves, main, main, ["node"]))
            ends = held if depth == DEPTH else held.where(F.col("rest") <= BRANCH)
            mains.append(ends.select("rid", "cls", "main").distinct())
            rests.append(ends.where("cls <> main AND rest > 1").select("rid", "cls", "node"))
            branch = held.where(F.col("rest") > BRANCH).select("rid", "node")
            steps.drop(here, leaves, main)
            done.append(held)
            if depth == DEPTH or branch.isEmpty():
                break
            here, depth = _nodes(steps, _children(branch, reps, similarity)), depth + 1
        crossing = steps.store(fold(DataFrame.unionAll, mains).distinct())
        sizes = steps.store(crossing.groupBy("main").agg(F.count("*").alias("n"), F.count(F.when(F.col("cls") != F.col("main"), 1)).alias("rest")))
        # nodes with the same members outside their largest class count once
        among = steps.store(fold(DataFrame.unionAll, rests))
        nodes = among.groupBy("node").agg(F.expr("bit_xor(xxhash64(rid))").alias("x"), F.sum(F.expr("xxhash64(rid, 7) >> 20")).alias("y"), F.count("*").alias("n"), F.min("cls").alias("c"), F.max("cls").alias("d")).where("c < d")
        steps.drop(*done)
        nodes = steps.store(nodes.groupBy("x", "y", "n").agg(F.min("node").alias("group")).select("group", "n", F.col("n").alias("total")))
        within = tk.skew_join(among.withColumnRenamed("node", "group"), nodes.select("group"), nodes.select("group", "n"), ["group"])
        # members take their sketches along before they are dealt out
        members = crossing.select("rid", "cls", "main", F.lit(None).cast("long").alias("group")).unionAll(within.select("rid", "cls", F.lit(None).cast("long"), "group"))
        members = steps.store(members.join(tk.merged(reps.select("rid", "sketch", "size")), "rid"))
        steps.drop(crossing, among)
        todo = _crossed(members.where("main IS NOT NULL").drop("group"), sizes)
        todo = todo.unionAll(_dealt(members.where("group IS NOT NULL").select("rid", "cls", "group", F.lit(-1).alias("side"), "sketch", "size"), nodes, LIMIT))
        todo = steps.store(todo)
        steps.drop(members, nodes, sizes)
        # by their sketches first: only members with a likely partner in another class take their full sets along
        kind = "rid bigint, cls bigint, `group` bigint, side int, sketch binary, size bigint"
        near = steps.store(_spread(todo, todo.count()).mapInArrow(tk.released(_likely(percent)), kind))
        steps.drop(todo)
        weighed = steps.store(near.groupBy("group").agg(F.sum("size").alias("total"), F.count("*").alias("n")))
        parted = steps.store(_dealt(near, weighed, ITEMS))
        more = _spread(parted.join(tk.merged(sets), "rid"), parted.count()).mapInArrow(tk.released(_across(percent)), "a bigint, b bigint")
        roots = components(spark, linked.unionByName(more))
        steps.drop(sets, near, parted, linked)
        placed = reps.select("rid", "low").join(tk.merged(roots.withColumnRenamed("node", "rid")), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        placed = steps.store(placed)
        least = steps.store(placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")))
        placed = steps.store(tk.skew_join(placed, least.select("root", "component_id"), least, ["root"]).select(F.col("rid").alias("a"), "component_id", F.col("root").alias("component")))
        rows = tk.skew_join(rows, placed, reps.select(F.col("rid").alias("a"), "n"), ["a"], "left")
        own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return steps.keep(rows.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), "component"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, tk.table(spark, sf_dir, "documents"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates (that of its least doc_id), and all rows without words; all columns stay.

    Only texts of rows that may go are shuffled.
    """
    found = near_duplicates(spark, docs, k, percent).where("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = tk.shared_checkpoint(spark, first.select("component", "n", F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("first_key")))
    grouped = tk.skew_join(found, first.drop("n"), first.select("component", "n"), ["component"])
    kept = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    # a row that stays is listed too: it may be there more than once
    listed = tk.shared_checkpoint(spark, grouped.select("doc_id", "text_key", kept.alias("kept")))
    by_id, by_key, key, words = tk.fresh(docs, "of_id", "of_key", "of_text", "has_words")
    some, rest = tk.parts(spark, docs, listed)
    gone = listed.where("NOT kept").select(F.col("doc_id").alias(by_id), F.col("text_key").alias(by_key)).distinct()
    left = some.join(tk.merged(gone), tk.named(docs, by_id, by_key), "left_anti")
    # the same row twice: one stays, but rows without words stay as they are
    left = left.withColumn(key, tk.text_key()).withColumn(words, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    left = left.where(words).dropDuplicates(["doc_id", key]).unionByName(left.where(f"NOT {words}"))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(rest)
