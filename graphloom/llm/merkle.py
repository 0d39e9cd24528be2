"""Merkle dataset manifest (operator 11).

Every row is a leaf; the leaves of a group, in order, form a tree of fan-out 16,
and the groups' roots, in order of the groups, another one on top. A tree is cut
into aligned blocks of 16**3 leaves. A block is traversed recursively, in
postorder, by one task: a call returns the digest of its subtree and, while it
unwinds, appends the siblings on either side to the paths of the leaves in it.
Digests of blocks are the leaves of the next distributed traversal, whose paths
come back to their blocks, so a path is complete after as many passes as the
tree has three levels; no task ever holds more than a block. Only digests and
keys are shuffled: texts are hashed where they are read.

Leaves are placed by a distributed sort over (group, key, leaf); the row counts
of the sort's ranges give each its place, so a group may hold any share of the
rows. The sorted table is written once and read by both passes: a lost executor
changes nothing.

A digest is the lower-case hex SHA-256 of the inputs concatenated, digests going
in as hex text. A lone leaf is its tree's root; in a tree of more leaves a run of
one node is hashed like any other.

Nulls: a null field hashes as "-"; a null group is a group of its own and comes
first, a null key comes first in its group. Ties: rows of one key are ordered by
their leaves; rows that are equal throughout are leaves of their own, in any
order, which changes no digest. Empty and very long texts are fields like others. An
empty table gives an empty one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

FAN_OUT = 16
#: Levels that one task traverses.
LEVELS = 3
BLOCK = FAN_OUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(fields: list[Column]) -> Column:
    """The leaf of some fields: each "-" if null, else its UTF-8 byte count, ":" and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to: a proof holds if this is the root."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path as one hex text, level by level from below, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(size: int) -> int:
    """Levels of a tree of so many leaves, LEVELS at most."""
    n = 0
    while size > 1 and n < LEVELS:
        size, n = -(-size // FAN_OUT), n + 1
    return n


def _traverse(digests: list[str], lo: int, hi: int, levels: int, paths: list[list[dict[str, str]]] | None) -> str:
    """The digest of the subtree over digests[lo:hi]; the siblings within it are appended to its leaves' paths."""
    if levels == 0:
        return digests[lo]
    step = FAN_OUT ** (levels - 1)
    spans = [(at, min(at + step, hi)) for at in range(lo, hi, step)]
    below = [_traverse(digests, a, b, levels - 1, paths) for a, b in spans]
    if paths is not None:
        for j, (a, b) in enumerate(spans):
            pair = {"left": "".join(below[:j]), "right": "".join(below[j + 1 :])}
            for leaf in range(a, b):
                paths[leaf].append(pair)
    return hashlib.sha256("".join(below).encode()).hexdigest()


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, place, size, digest) of the blocks of nodes, which has the same columns: the nodes of the next traversal."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        size = block.column("size")[0].as_py()
        levels = _levels(size)
        root = _traverse(block.column("digest").to_pylist(), 0, len(block), levels, None)
        return pa.table({"tree": block.column("tree")[:1], "place": pa.array([block.column("place")[0].as_py() // BLOCK], pa.int64()), "size": pa.array([-(-size // FAN_OUT**levels)], pa.int64()), "digest": pa.array([root])})

    return nodes.select("tree", "place", "size", "digest").groupBy("tree", (F.col("place") / BLOCK).cast("long").alias("block")).applyInArrow(run, "tree string, place bigint, size bigint, digest string")


def _with_paths(nodes: DataFrame, above: DataFrame, extra: str) -> DataFrame:
    """nodes with their paths to the top, and the columns `extra` (DDL) of their block; above has a row for each block: tree, block, path and those columns."""
    more = [x.split()[0] for x in extra.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields) + f", path {_PATH}, {extra}"

    def run(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.drop_columns(["block"]).sort_by("place")
        paths: list[list[dict[str, str]]] = [[] for _ in range(len(block))]
        _traverse(block.column("digest").to_pylist(), 0, len(block), _levels(block.column("size")[0].as_py()), paths)
        rest = top.column("path")[0].as_py()
        out = block.append_column("path", pa.array([p + rest for p in paths], _PATH_TYPE))
        for name in more:
            out = out.append_column(name, pa.array([top.column(name)[0].as_py()] * len(block), top.column(name).type))
        return out

    dealt = nodes.withColumn("block", (F.col("place") / BLOCK).cast("long"))
    return dealt.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def _above(steps: tk.Steps, nodes: DataFrame) -> DataFrame:
    """(tree, block, path, root) for each block of nodes (tree, place, size, digest): the path from its digest up."""
    blocks = steps.store(_blocks(nodes))
    if blocks.where("size > 1").isEmpty():
        return blocks.select("tree", F.col("place").alias("block"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    done = _with_paths(blocks, _above(steps, blocks), "root string")
    return steps.store(done.select("tree", F.col("place").alias("block"), "path", "root"))


def _placed(steps: tk.Steps, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """leaves (tree, digest, ...) with their place in their tree, in order of keys, and the tree's size."""
    row, part = F.col("at").bitwiseAND(2**33 - 1), F.shiftright("at", 33)
    ordered = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("tree", *keys, "tie").sortWithinPartitions("tree", *keys, "tie")
    ordered = steps.store(ordered.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumns({"part": part, "row": row}).drop("at"))
    # a row for each tree in each range of the sort
    cells = steps.store(ordered.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    by = Window.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = steps.store(cells.withColumns({"before": before, "size": F.sum("n").over(Window.partitionBy("tree"))}).drop("n"))
    return steps.store(ordered.join(tk.small(cells), ["tree", "part"]).withColumn("place", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before"))


def manifest(spark: SparkSession, docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "source", key: str = "doc_id", claim: Column | None = None) -> DataFrame:
    """A row for each row of docs: key, leaf, claimed (the column `claim`, or the leaf), path, subroot (its group's root), root.

    path has the siblings of every level up to root as {left, right}; fold(claimed, path) = root verifies a row against the manifest.
    """
    tree = F.when(F.col(by).isNull(), "").otherwise(F.concat(F.lit("="), F.col(by).cast("string")))  # null sorts first
    leaf = digest([F.col(c) for c in fields])
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), (leaf if claim is None else claim).alias("claimed"))
    with tk.Steps(spark) as steps:
        leaves = steps.store(rows)
        nodes = _placed(steps, leaves, ["key", "digest"])
        above = _above(steps, nodes)
        roots = steps.store(above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")))
        groups = _placed(steps, roots, ["of"])
        tops = steps.store(_with_paths(groups, _above(steps, groups), "root string").select(F.col("of").alias("tree"), F.col("path").alias("rest"), F.col("root").alias("top")))
        counts = steps.store(above.groupBy("tree").agg(F.count("*").alias("n")))
        above = steps.store(tk.skew_join(above, tops, counts, ["tree"]).select("tree", "block", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root")))
        for table in (nodes, above):  # read by the result, which is lazy
            steps.hold(table)
        done = _with_paths(nodes, above, "subroot string, root string")
        return done.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "claimed", "path", "subroot", "root")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(tampered, digest([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS])).otherwise(digest([F.col(c) for c in FIELDS]))
    rows = manifest(spark, docs, claim=claim)
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int) -> str:
    """Both trees level by level: n{k} has a node for each run of 16**k leaves; a tree of one node stays as it is."""
    field = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(f"{c}::VARCHAR") for c in FIELDS[:-1]) + f" || {field(text)})"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"

    def climb(name: str, start: str) -> tuple[str, str]:
        parts = [f"{name}0 AS ({start})"]
        for k in range(levels):
            parts.append(
                f"{name}s{k} AS (SELECT tree, place, digest, size, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WINDOW w AS (PARTITION BY tree, place // 16 ORDER BY place))"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT tree, place // 16 AS place, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest, "
                f"(any_value(size) + 15) // 16 AS size FROM {name}{k} GROUP BY tree, place // 16)"
            )
        return ", ".join(parts), f"{name}{levels}"

    def walk(name: str, begin: str, at: str) -> str:
        """Steps from `begin` (tree, place, at, leaf, acc, proof, ...) up to the root of its tree."""
        parts, last = [], begin
        for k in range(levels):
            parts.append(
                f"{at}{k} AS (SELECT b.* EXCLUDE (acc, proof), CASE WHEN s.size > 1 THEN sha256(s.l || b.acc || s.r) ELSE b.acc END AS acc, b.proof || s.l || s.r AS proof "
                f"FROM {last} b JOIN {name}s{k} s ON b.tree = s.tree AND b.place // {16**k} = s.place)"
            )
            last = f"{at}{k}"
        return ", ".join(parts)

    table = "list_transform(range(0, 256), lambda b: list_reduce(list_concat([b], range(0, 8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    ascii_ = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    crc32 = f"xor(list_reduce(list_concat([4294967295], {ascii_}), lambda x, c: xor(x // 256, t[xor(x, c) % 256 + 1])), 4294967295)"
    nodes, top = climb("n", "SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM d")
    groups, root = climb("g", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, count(*) OVER () AS size FROM {top}")
    return f"""
WITH crc AS MATERIALIZED (SELECT {table} AS t),
d AS MATERIALIZED (SELECT coalesce('=' || source, '') AS tree, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc32} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM documents, crc),
{nodes}, {groups},
p AS (SELECT tree, doc_id, leaf, claimed AS acc, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{walk('n', 'p', 'u')},
q AS (SELECT '' AS tree, b.place, u.doc_id, u.leaf, u.acc, u.proof, b.subroot FROM u{levels - 1} u JOIN (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM {top}) b USING (tree)),
{walk('g', 'q', 'v')}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM v{levels - 1}, (SELECT digest AS root FROM {root})
"""


#: 16**6 leaves in a source, and as many sources, at most.
OP11_SQL = _sql(6)
