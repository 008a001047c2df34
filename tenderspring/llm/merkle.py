"""Merkle manifest of a dataset: a binary hash tree for each group of rows, and one over the groups' roots.

Partial parents gather numbered child digests; from the size of its level a parent knows how many children it
has, and is made as soon as they are there. Each task first does so with the rows that it has; what is left
unmade is dealt out by the block of 4096 nodes it lies under, where all of it meets. A round lifts a level by
twelve; the way back down links every node with its siblings, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Levels that a round lifts; a block has 2**12 nodes at most.
BITS = 12
_NODE = "key string, n long, level int, index long, digest string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns: `-` for null, else the value's length in UTF-8 bytes, `:` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The written rows with `index`, from 0 within their key in the order of these columns, and `n`, the key's rows.

    Rows are dealt out by ranges of (key, order), so that a large key lies in many tasks; a task numbers its
    own, and the counts of those before it are added. The order must tell all rows of a key apart.
    """
    columns = ["key", *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            at = []
            for key in batch.column("key").to_pylist():
                if key != now:
                    now, n = key, 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "part", "at"])

    placed = rows.repartitionByRange(*(F.col(c) for c in columns)).sortWithinPartitions(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = settle(placed.mapInArrow(run, f"{schema}, part int, at long"), "placed")
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy("key")).alias("n"))
    return placed.join(sizes, ["key", "part"]).withColumn("index", F.col("base") + F.col("at")).drop("part", "at", "base")


def _combiner(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["key", "n", "level", "index", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes (key, n, level, index, digest) to what can be made of them: tops of blocks, and children whose parent
        lacks one. n is the size of the key's level 0; levels count from there."""
        waiting: dict[tuple, tuple] = {}
        for batch in batches:
            made = []
            for key, n, level, index, digest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                while True:
                    size = -(-n >> level)
                    if level == bits or size == 1:
                        made.append((key, n, level, index, digest))
                        break
                    parent = (key, level + 1, index >> 1)
                    if size - 2 * (index >> 1) == 1:
                        digest = sha(digest)
                    elif parent in waiting:
                        _, other, at = waiting.pop(parent)
                        digest = sha(other + digest if at < index else digest + other)
                    else:
                        waiting[parent] = (n, digest, index)
                        break
                    level, index = level + 1, index >> 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)
        left = [(key, n, level - 1, index, digest) for (key, level, _), (n, digest, index) in waiting.items()]
        for at in range(0, len(left), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left[at : at + 10_000], strict=True), kinds, strict=True)], names)

    return run


def lifted(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, n, index, digest) of the level `bits` above nodes(key, n, index, digest); a key of at most 2**bits nodes has
    its root there. n is that level's size."""
    block = F.expr(f"shiftright(index, {bits} - level)")
    first = nodes.select("key", "n", F.lit(0).alias("level"), "index", "digest").mapInArrow(_combiner(bits), _NODE)
    tops = first.repartition("key", block).mapInArrow(_combiner(bits), _NODE)
    return tops.select("key", F.ceil(F.col("n") / F.lit(2**bits)).cast("long").alias("n"), block.alias("index"), "digest")


def rounds(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """nodes(key, n, index, digest) and the levels above, each `bits` higher, the last with one node a key. All are written."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(settle(lifted(levels[-1], bits), "level"))
    return levels


def _paths(nodes: DataFrame, above: DataFrame, extra: Sequence[str], bits: int) -> DataFrame:
    """nodes(key, n, index, digest, *extra) with `path`: an entry for each level up to the root, L or R (where the sibling
    lies) and its digest, empty for a node alone in its run. above(key, index, path) has those of their blocks."""
    block = F.shiftright("index", bits)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select("key", "index", *extra).schema)

    def run(own: pa.Table, up: pa.Table) -> pa.Table:
        own = own.sort_by("index")
        digests, n = own.column("digest").to_pylist(), own.column("n")[0].as_py() if own.num_rows else 0
        paths: list[list[str]] = [[] for _ in digests]
        level, now = 0, digests
        while level < bits and -(-n >> level) > 1:
            for i, path in enumerate(paths):
                j = (i >> level) ^ 1
                path.append("" if j >= len(now) else ("R" if j & 1 else "L") + now[j])
            now = [sha(now[i] + (now[i + 1] if i + 1 < len(now) else "")) for i in range(0, len(now), 2)]
            level += 1
        rest = up.column("path")[0].as_py() if up.num_rows else []
        return pa.table([*(own.column(c) for c in ("key", "index", *extra)), pa.array([p + rest for p in paths], pa.list_(pa.string()))], names=["key", "index", *extra, "path"])

    left = nodes.select(*dict.fromkeys(("key", "n", "index", "digest", *extra)), block.alias("block")).groupBy("key", "block")
    right = above.select("key", F.col("index").alias("block"), "path").groupBy("key", "block")
    return left.cogroup(right).applyInArrow(run, f"{schema}, path array<string>")


def linked(levels: list[DataFrame], extra: Sequence[str] = (), top: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """(key, index, *extra, path) of levels[0], as rounds() gives them; top(key, path): how each key's root goes on."""
    paths = levels[-1].select("key", "index", F.array().cast("array<string>").alias("path"))
    if top is not None:
        paths = paths.drop("path").join(top.select("key", "path"), "key")
    for nodes in reversed(levels[:-1]):
        kept = extra if nodes is levels[0] else ()
        paths = _paths(nodes, paths, kept, bits) if nodes is levels[0] else settle(_paths(nodes, paths, kept, bits), "paths")
    if len(levels) == 1:
        return paths.join(levels[0].select("key", "index", *extra), ["key", "index"]) if extra else paths
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.when(s.startswith("L"), F.concat(F.substr(s, F.lit(2)), a)).otherwise(F.concat(a, F.substr(s, F.lit(2)))), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2))), ""), 256)


def manifest(rows: DataFrame, columns: Sequence[str], group_col: str = "lang", id_col: str = "doc_id", claimed: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path) for every row; `columns` go into a leaf, in this order.

    Rows of a group are leaves in the order of their ids, null ids first, equal ids by their digests; rows that
    repeat are leaves each. A null group is one of its own, before the others, which follow by their bytes. Null
    and empty values are told apart. claimed: columns to take in place of others, for the digest `claimed` of
    a row as somebody else has it. The rows given are read once. No rows: none. Other columns aren't read.
    """
    names = list(columns)
    key = F.coalesce(F.concat(F.lit("."), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    given = {c: F.col(f"`{c}`") for c in names}
    other = given | (claimed or {})
    leaves = rows.select(
        key.alias("key"), F.col(f"`{id_col}`").alias("id"), leaf_digest(*given.values()).alias("digest"), leaf_digest(*(other[c] for c in names)).alias("claimed"), F.monotonically_increasing_id().alias("row")
    )
    leaves = settle(numbered(settle(leaves, "leaves"), ["id", "digest", "row"]), "numbered")
    levels = rounds(leaves, bits)
    subroots = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    groups = settle(numbered(settle(subroots, "subroots"), ["group"]), "groups")
    above = rounds(groups, bits)
    root = above[-1].first()
    tops = linked(above, ["group"] if len(above) > 1 else [], bits=bits)
    tops = tops.drop("key") if len(above) > 1 else groups.select("group", F.array().cast("array<string>").alias("path"))
    paths = linked(levels, ["id", "digest", "claimed"], tops.select(F.col("group").alias("key"), "path"), bits)
    known = levels[-1].select("key", F.col("digest").alias("subroot"), F.lit(root["digest"] if root else None).cast("string").alias("root"))
    return paths.join(known, "key").select("id", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")
