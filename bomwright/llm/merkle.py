"""A Merkle manifest of a dataset: one root for all rows, and for each row a proof that leads to it.

Every row's digest is a leaf. The leaves of a group, in order, are hashed in runs of
``FANOUT``, these again, and so on until one node is left, the group's root; the roots
of all groups are hashed likewise to the root of the dataset. A lone leaf is its
group's root; a run that is cut short, even to one node, is hashed as it is.

Trees are cut into aligned blocks of ``FANOUT ** DEPTH`` nodes, so that a block's top is
a node of the whole tree. In a block the 64-byte hex digests are one contiguous numpy
matrix: a level's rows are the matrix reshaped by the fanout, and the place of every
sibling follows from the row's number by division. Blocks are dealt to tasks; their
tops are the nodes of the next round, and rounds, each written to the shared folder,
go on until each tree is one node (two rounds for 4.8 million rows a group, three for
ten thousand million). On the way down each block gets the path from its top to the
root as one row that is sorted before its nodes, and adds it to each node's own path.

The place of a row in its group comes from a sort by ranges: a range knows how far its
rows are from where their group begins in it, and only the first group of a range can
have begun before. One row a range comes to the driver. So a group may hold all rows.

Defined results: rows of one group with one id are ordered by their digest (equal rows
have equal digests and neighbouring places), null ids come first; a null group is a
group, the first; null and empty values differ; texts may be of any length; an empty
table gives no rows; columns that are not named have no part in a digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import materialize, named, small_batches, table

FANOUT = 3
#: Levels of a block.
DEPTH = 7
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: list[Column]) -> Column:
    """Hex sha256 of the values, each a dash if null, else its bytes' number, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column tree) and pos, each row's place in its tree by ``order``, from 0."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = ranged.columns.index("tree")

    def run(batches):
        part, first, before, n = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            trees = batch.column(at).to_pylist()
            places = np.zeros(len(trees), np.int64)
            for k, tree in enumerate(trees):
                n = n + 1 if before == (tree,) else 0
                first = first or (tree,)
                before, places[k] = (tree,), n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(trees), pa.int32()), pa.array([first == (t,) for t in trees], pa.bool_()), pa.array(places)],
                names=[*batch.schema.names, "part", "is_first", "place"],
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)
    found = materialize(ranged.mapInArrow(run, f"{schema}, part int, is_first boolean, place bigint"), "merkle-placed")
    # One row a range comes to the driver.
    ends = found.groupBy("part").agg(F.min(F.struct("tree")).alias("low"), F.max(F.struct("tree", "place")).alias("high")).orderBy("part").collect()
    starts, open_tree, n = [], None, 0
    for r in ends:
        low, high = (r.low.tree,), (r.high.tree,)
        begun = n if open_tree == low else 0
        starts.append((r.part, begun))
        open_tree, n = high, r.high.place + 1 + (begun if low == high else 0)
    begun = spark.createDataFrame(starts, "of_part int, begun bigint")
    pos = F.col("place") + F.when(F.col("is_first"), F.col("begun")).otherwise(F.lit(0))
    return found.join(F.broadcast(begun), F.col("part") == F.col("of_part")).withColumn("pos", pos).drop("of_part", "begun", "part", "is_first", "place")


def hash_rows(nodes: np.ndarray) -> np.ndarray:
    """The next level: hex digests of rows of ``FANOUT`` nodes; the last row may be shorter."""
    whole = len(nodes) // FANOUT * FANOUT
    rows = list(np.ascontiguousarray(nodes[:whole]).reshape(-1, FANOUT * HEX))
    if whole < len(nodes):
        rows.append(np.ascontiguousarray(nodes[whole:]).reshape(-1))
    return np.frombuffer("".join(sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, HEX)


def levels(nodes: np.ndarray, first_block: bool, depth: int = DEPTH) -> list[np.ndarray]:
    """A block's levels, its nodes first and its top last. A tree that is one block ends where one node is left, in others each block has all levels."""
    out = [nodes]
    while len(out) <= depth and not (first_block and len(nodes) < FANOUT**depth and len(out[-1]) == 1):
        out.append(hash_rows(out[-1]))
    return out


def paths(found: list[np.ndarray]) -> tuple[list[str], list[str]]:
    """For each node of a block, from the bottom up: how many siblings are left and right of it (two digits a level), and their digests."""
    n = len(found[0])
    turns, siblings = [""] * n, [""] * n
    number = np.arange(n)
    others = np.array([[j for j in range(FANOUT) if j != own] for own in range(FANOUT)])
    for level in found[:-1]:
        begin = number // FANOUT * FANOUT
        own = number - begin
        size = np.minimum(FANOUT, len(level) - begin)
        rows = level[np.minimum(begin[:, None] + others[own], len(level) - 1)].reshape(n, -1).tobytes().decode()
        width = (FANOUT - 1) * HEX
        for k, (left, all_of) in enumerate(zip(own.tolist(), size.tolist(), strict=True)):
            turns[k] += f"{left}{all_of - 1 - left}"
            siblings[k] += rows[k * width : k * width + (all_of - 1) * HEX]
        number = number // FANOUT
    return turns, siblings


def fold(node: str, turns: str, siblings: str) -> str:
    """The root that a node and its path lead to."""
    at = 0
    for k in range(0, len(turns), 2):
        left, right = at + HEX * int(turns[k]), HEX * int(turns[k + 1])
        node = sha256((siblings[at:left] + node + siblings[left : left + right]).encode()).hexdigest()
        at = left + right
    return node


def _matrix(nodes: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(nodes.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """Whole blocks in one task, sorted by tree, block and ``order``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", *order)


def _blocks(batches: Iterator[pa.RecordBatch], begins) -> Iterator[pa.Table]:
    """Whole blocks out of sorted rows; ``begins`` tells which rows of a batch are a block's first."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = np.flatnonzero(begins(batch))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if a in cuts and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            if b > a:
                rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def tops(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, pos and node of the next round: the top of each block of nodes (tree, pos, node)."""
    size = FANOUT**depth
    block = F.floor(F.col("pos") / size).cast("bigint")
    rows = _dealt(nodes.select("tree", block.alias("block"), "pos", "node"), ["pos"])

    def run(batches):
        for t in _blocks(batches, lambda b: b.column(2).to_numpy() % size == 0):
            at = t["block"][0].as_py()
            top = levels(_matrix(t["node"].combine_chunks()), at == 0, depth)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([t["tree"][0].as_py()], pa.string()), pa.array([at], pa.int64()), pa.array([top.tobytes().decode()])], names=["tree", "pos", "node"])

    return materialize(rows.mapInArrow(run, "tree string, pos bigint, node string"), "merkle-tops")


def with_paths(nodes: DataFrame, above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes (tree, pos, node and others) with turns, siblings and subroot up to the root; ``above`` has those of each block's top (tree, pos, turns, siblings, subroot).

    The path of a block comes as one row before its nodes, so it is not repeated for each on its way.
    """
    keep = [c for c in nodes.columns if c not in ("tree", "pos", "node")]
    types = dict(nodes.dtypes)
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    size = FANOUT**depth
    block = F.floor(F.col("pos") / size).cast("bigint")
    own = nodes.select("tree", block.alias("block"), "pos", "node", *map(none, ("turns", "siblings", "subroot")), *keep)
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), none("node"), "turns", "siblings", "subroot", *(none(c, types[c]) for c in keep))
    rows = _dealt(own.unionByName(heads), ["pos"])

    def run(batches):
        for t in _blocks(batches, lambda b: b.column(2).to_numpy() < 0):
            head, t = t.slice(0, 1).to_pylist()[0], t.slice(1).combine_chunks()
            turns, siblings = paths(levels(_matrix(t["node"].combine_chunks()), head["block"] == 0, depth))
            for name, values in (("turns", turns), ("siblings", siblings)):
                t = t.set_column(t.column_names.index(name), name, pa.array([x + head[name] for x in values], pa.string()))
            t = t.set_column(t.column_names.index("subroot"), "subroot", pa.array([head["subroot"]] * len(t), pa.string()))
            yield from t.drop_columns(["block"]).to_batches(500)

    return rows.mapInArrow(run, "tree string, pos bigint, node string, turns string, siblings string, subroot string" + "".join(f", `{c}` {types[c]}" for c in keep))


def _rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes and the tops of their blocks, round by round, to one node a tree."""
    out = [nodes]
    last = nodes.agg(F.max("pos")).first()[0] or 0  # one number a call comes to the driver
    while last:
        out.append(tops(out[-1], depth))
        last //= FANOUT**depth
    return out


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """One row per document: its ``order`` column, tree (its group), leaf, subroot, root, turns and siblings (its proof, see ``fold``), and the columns of ``carry``."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(group).cast("string").alias("tree"), digest([named(c) for c in fields]).alias("node"), named(order).alias("key"), *(named(c).alias(f"c{k}") for k, c in enumerate(carry)))
    of_rows = _rounds(placed(materialize(rows, "merkle-leaves"), ["key", "node"]), depth)
    of_groups = _rounds(placed(of_rows[-1].select(F.lit("").alias("tree"), "node", F.col("tree").alias("name")), ["name"]), depth)
    root = of_groups[-1].select("node").first()  # one row, none for an empty table
    known = of_groups[-1].select("*", F.lit("").alias("turns"), F.lit("").alias("siblings"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(of_groups[:-1]):
        known = with_paths(nodes, known, depth)
    known = known.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "turns", "siblings", F.col("node").alias("subroot"))
    # Where every group is a lone leaf, the leaves themselves are the roots: they still get their columns.
    for nodes in reversed(of_rows[: max(1, len(of_rows) - 1)]):
        known = with_paths(nodes, known, depth)
    return known.select(F.col("key").alias(order), "tree", F.col("node").alias("leaf"), "subroot", F.lit(root and root[0]).alias("root"), "turns", "siblings", *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)))


def folded(rows: DataFrame, node: str, into: str) -> DataFrame:
    """``rows`` (with turns and siblings) and the root that the digest in the column ``node`` leads to."""
    at = [rows.columns.index(c) for c in (node, "turns", "siblings")]

    def run(batches):
        for batch in batches:
            roots = [fold(*r) for r in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(into, StringType())]))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without_breaks = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    found = manifest(docs.withColumn("tampered", F.when(altered, digest(without_breaks))), carry=("tampered",))
    checked = folded(found.withColumn("given", F.coalesce("tampered", "leaf")), "given", "folded_root")
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _shown(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_shown(text if c == 'text' else c) for c in FIELDS)})"


def _tree(name: str, leaves: str, key: str) -> str:
    """Levels of the trees of ``leaves`` (key, pos, node), their roots, and at each node its siblings left and right."""
    return f"""{name} AS (
  SELECT {key}, 0 AS lvl, pos, node, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
  UNION ALL
  SELECT {key}, any_value(lvl) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {key}, pos // 3
), {name}_root AS (SELECT {key}, node, lvl AS height FROM {name} WHERE n = 1
), {name}_beside AS (
  SELECT {key}, lvl, pos, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY {key}, lvl, pos // 3 ORDER BY pos)
)"""


#: The remainder by two of a number's crc32, bit by bit.
_ODD = "list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: list_reduce(list_concat([xor(r, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) & 1"

OP12_SQL = f"""WITH RECURSIVE told AS (
  SELECT doc_id, 's' || source AS of_source, {_leaf('text')} AS leaf, CASE WHEN ({_ODD}) = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS given FROM documents
), leaves AS (SELECT coalesce(of_source, '') AS k, row_number() OVER (PARTITION BY of_source ORDER BY doc_id, leaf) - 1 AS pos, leaf AS node, doc_id, given FROM told
), {_tree('own', 'leaves', 'k')}, subroots AS (SELECT 0 AS t, row_number() OVER (ORDER BY k) - 1 AS pos, node, k FROM own_root
), {_tree('whole', 'subroots', 't')}, path AS (
  SELECT doc_id, l.k, b.lvl AS step, before, after FROM leaves l JOIN own_root r ON r.k = l.k CROSS JOIN generate_series(0, 60) g(h) JOIN own_beside b ON b.k = l.k AND b.lvl = h AND h < r.height AND b.pos = l.pos // (3 ** h)::BIGINT
  UNION ALL
  SELECT doc_id, l.k, r.height + b.lvl, before, after FROM leaves l JOIN own_root r ON r.k = l.k JOIN subroots s ON s.k = l.k CROSS JOIN generate_series(0, 60) g(h) JOIN whole_beside b ON b.lvl = h AND b.pos = s.pos // (3 ** h)::BIGINT
), folded AS (
  SELECT doc_id, 0 AS step, given AS node FROM leaves
  UNION ALL SELECT f.doc_id, f.step + 1, sha256(before || node || after) FROM folded f JOIN path p ON p.doc_id = f.doc_id AND p.step = f.step
)
SELECT l.doc_id, l.node AS leaf, r.node AS subroot, w.node AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.node AS folded_root, f.node = w.node AS verified
FROM leaves l JOIN own_root r ON r.k = l.k CROSS JOIN whole_root w LEFT JOIN (SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS siblings FROM path GROUP BY doc_id) p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, max_by(node, step) AS node FROM folded GROUP BY doc_id) f ON f.doc_id = l.doc_id"""
