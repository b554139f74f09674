"""Merkle manifest of a dataset by time-forward processing.

Nodes carry labels (level, place), in the order in which they become known. A node's digest
is a message to its parent; a priority queue ordered by label hands the messages on, so a
parent is computed when its label comes up and no tree is held. The queue is external: the
nodes of every fourth level are a table in the shared folder, and a task runs the queue over
one aligned block of 8^4 nodes, however many rows a tree has. A reversed sweep then
goes down the same tables and hands each node the proof suffix of its parent, until every
leaf has its proof. A group of equal keys spans as many blocks as it needs.

A tree is a value of a column; its leaves ascend by an id. While multiple nodes remain, every
8 consecutive ones (the last run may be fewer, even one) become the digest of their digests,
in hex. The roots of the trees, in the order of that column, are the leaves of one more tree.

NULL tree values make a tree of their own, the first; NULL ids are the first of their tree.
Rows that share an id are in the order of their digests, so equal rows are interchangeable.
NULL fields of a leaf are ``-``; an empty table has no nodes, no root and no proofs. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainshift.operators.windows import repeat_index
from strainshift.session import materialise

#: Eight, as three bits of a place.
FANOUT = 8
#: Levels between two tables of nodes; a group of a task holds at most FANOUT ** LEVELS nodes.
LEVELS = 4
#: A tree's name without NULL: whether it has one, and which.
TREE = ["named", "tree"]
NODES = "named boolean, tree string, pos bigint, digest binary"
#: One step of a proof: the node's place in its run, and the digests of the others, left to right.
STEPS = "array<struct<own: int, others: binary>>"


def field(value: Column) -> Column:
    """``-`` for NULL, else byte count, colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the fields after one another."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def parent(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def climb(digests: list[bytes]):
    """Levels of one block, from its nodes to its top, through the queue of messages.

    The smallest labels are the waiting children of one parent, since labels ascend by level
    and place.
    """
    queue = [(0, i, d) for i, d in enumerate(digests)]  # in order, so already a heap
    levels, sizes = [digests], [len(digests)]
    while len(levels[-1]) > 1 or queue[0][0] < len(levels) - 1:
        level, place, _ = queue[0]
        if level == len(levels) - 1:
            levels.append([])
            sizes.append(-(-sizes[level] // FANOUT))
        run = [heapq.heappop(queue)[2] for _ in range(min(FANOUT, sizes[level] - place))]
        message = parent(run)
        levels[level + 1].append(message)
        heapq.heappush(queue, (level + 1, place // FANOUT, message))
        if len(levels[-1]) == sizes[-1] == 1:
            break
    return levels


def block_levels(block: int, digests: list[bytes], height: int) -> list[list[bytes]]:
    """The same for a block of a tree: one after the first has the whole height above it, however few nodes it holds."""
    levels = climb(digests)
    while block and len(levels) <= height:
        levels.append([parent(levels[-1])])
    return levels


def descend(levels: list[list[bytes]], suffix: list) -> list[list]:
    """The reversed sweep: the proof of each node of the lowest level, given that of the block's top."""
    known = [suffix]
    for level in reversed(levels[:-1]):
        below = []
        for i in range(len(level)):
            head = i - i % FANOUT
            others = b"".join(level[head:i]) + b"".join(level[i + 1:head + FANOUT])
            below.append([(i % FANOUT, others), *known[i // FANOUT]])
        known = below
    return known


def fold(digest: bytes, steps: list) -> bytes:
    """The root that a leaf and its proof lead to."""
    for own, others in steps:
        others = others.hex()
        digest = sha256((others[:64 * own] + digest.hex() + others[64 * own:]).encode()).digest()
    return digest


def place(leaves: DataFrame, tree: str, doc: str, digest: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Leaves with their tree's name and their place in it, from 0; written once."""
    rows = leaves.select(F.col(tree).isNotNull().alias("named"), F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("tree"),
                         F.col(doc).alias("id"), F.col(digest).alias("digest"), *carry)
    numbered = repeat_index(materialise(rows), TREE, ["id", "digest"], "pos")
    return materialise(numbered.withColumn("pos", F.col("pos").cast("long") - 1))


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", 3 * height)).groupBy(*TREE, "block")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def sweep_up(leaves: DataFrame, height: int = LEVELS) -> list[DataFrame]:
    """The tables of nodes, each `height` levels above the one before; the last has one node per tree."""
    kind = pa.schema([("named", pa.bool_()), ("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary())])

    def run(table):
        table = _sorted(table)
        block = table["block"][0].as_py()
        top = block_levels(block, table["digest"].to_pylist(), height)[-1][0]
        return pa.table([[table["named"][0].as_py()], [table["tree"][0].as_py()], [block], [top]], schema=kind)

    tables = [leaves]
    while True:
        nodes = tables[-1].select(*TREE, "pos", "digest")
        tables.append(materialise(_blocked(nodes, height).applyInArrow(run, NODES)))
        if tables[-1].where("pos > 0").isEmpty():
            return tables


def sweep_down(nodes: DataFrame, above: DataFrame, per_node, schema: str, height: int = LEVELS) -> DataFrame:
    """Hand the proofs of a table of nodes down to the table below it.

    ``above`` has the tree, pos, steps, subroot and root of every node over a block of
    ``nodes``. ``per_node(row, steps, subroot, root)`` makes a tuple of ``schema`` from each
    row of ``nodes``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(table, over):
        table = _sorted(table)
        rows, top = table.to_pylist(), over.to_pylist()[0]
        levels = block_levels(rows[0]["block"], [r["digest"] for r in rows], height)
        proofs = descend(levels, [(s["own"], s["others"]) for s in top["steps"]])
        out = [per_node(r, steps, top["subroot"], top["root"]) for r, steps in zip(rows, proofs)]
        return pa.table([pa.array(list(c), k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)

    over = above.withColumnRenamed("pos", "block").groupBy(*TREE, "block")
    return _blocked(nodes, height).cogroup(over).applyInArrow(run, schema)


ABOVE = f"{NODES.replace('digest binary', f'steps {STEPS}')}, subroot binary, root binary"


def _node(row, steps, subroot, root):
    return row["named"], row["tree"], row["pos"], [{"own": a, "others": b} for a, b in steps], subroot, root


def _through(tables: list[DataFrame], above: DataFrame, per_leaf, schema: str, height: int) -> DataFrame:
    for nodes in reversed(tables[1:-1]):
        above = materialise(sweep_down(nodes, above, _node, ABOVE, height))
    return sweep_down(tables[0], above, per_leaf, schema, height)


def prove(leaves: DataFrame, per_leaf, schema: str, height: int = LEVELS) -> DataFrame:
    """A row for each leaf of ``place``: per_leaf(row, steps, subroot, root), the row being a dict.

    ``steps`` is the proof, a list of (place in the run, digests of the others) from the leaf
    to the root.
    """
    trees = sweep_up(leaves, height)
    # the trees' roots, in order, are the leaves of the last tree
    roots = repeat_index(trees[-1].select(*TREE, F.col("digest").alias("subroot")), [], [*TREE], "pos")
    roots = materialise(roots.select(F.lit(True).alias("named"), F.lit("").alias("tree"), (F.col("pos").cast("long") - 1).alias("pos"),
                                     F.col("subroot").alias("digest"), F.col("named").alias("of_named"), F.col("tree").alias("of_tree")))
    forest = sweep_up(roots, height)
    top = forest[-1].select(*TREE, "pos", F.array().cast(STEPS).alias("steps"), F.lit(None).cast("binary").alias("subroot"),
                            F.col("digest").alias("root"))

    def handed(row, steps, subroot, root):
        return row["of_named"], row["of_tree"], 0, [{"own": a, "others": b} for a, b in steps], row["digest"], root

    return _through(trees, materialise(_through(forest, top, handed, ABOVE, height)), per_leaf, schema, height)
