"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, one tree over the groups, a proof for each row.

Rows of a group are numbered in their order by range partitions, whatever the group's size.  A block is `fanout` to the
power m consecutive nodes, aligned: one task holds its digests as a matrix of 64 hex bytes a row, reshapes it by the
fanout and hashes the rows of each level.  In a group of several blocks each block goes up exactly m levels, and what the
blocks become is the next table of nodes, until a group has one.  On the way down each block gets its own node's
proof and puts it behind the siblings within the block, which are found by arithmetic on indexes alone.  No task holds
more than a block, and each level is a written table.

A node's digest is the digest of its run's hex digests put together; a last run may be shorter, down to one.  A group with one row
has that row's leaf as its subroot, a dataset with one group that group's subroot as its root.  Null groups come first and
are a group of their own, null order keys come first, ties go by leaf; repeated rows are leaves each.  An empty table
gives an empty manifest.  Further columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, only, table

#: Digests in a block, at most.
BLOCK = 1024
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: What is known of a node from above: the hex siblings from it up to the root, and for each level its place in its run and the run's size, a byte each.
PATH = "proof string, places binary, sizes binary, subroot string, root string"


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the values, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# ---- one block -----------------------------------------------------------------------------------

def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Hex digests as rows of 64 bytes."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """Hex digest of each row of bytes."""
    data, wide = rows.tobytes(), rows.shape[1]
    return np.frombuffer("".join(hashlib.sha256(data[k:k + wide]).hexdigest() for k in range(0, len(data), wide)).encode(), np.uint8).reshape(-1, 64)


def levels(digests: np.ndarray, fanout: int, most: int | None = None) -> list[np.ndarray]:
    """The digests, and those of each level above: `most` levels, or up to a single node."""
    out = [digests]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        last = out[-1]
        full = len(last) // fanout * fanout
        runs = [hash_rows(part.reshape(-1, wide * 64)) for part, wide in ((last[:full], fanout), (last[full:], len(last) - full)) if len(part)]
        out.append(np.concatenate(runs))
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all leaves at once: sibling digests (leaf, slot, 64), which slots are taken, places and sizes of runs (leaf, level)."""
    n, depth = len(tree[0]), len(tree) - 1
    digests, taken = np.zeros((n, depth, fanout - 1, 64), np.uint8), np.zeros((n, depth, fanout - 1), bool)
    places, sizes = np.zeros((n, depth), np.uint8), np.zeros((n, depth), np.uint8)
    at = np.arange(n)
    for t, nodes in enumerate(tree[:-1]):
        first, place = at // fanout * fanout, at % fanout
        places[:, t], sizes[:, t] = place, np.minimum(fanout, len(nodes) - first)
        for slot in range(fanout - 1):
            other = first + slot + (slot >= place)
            taken[:, t, slot] = other < len(nodes)
            digests[:, t, slot] = nodes[np.minimum(other, len(nodes) - 1)]
        at = at // fanout
    return digests.reshape(n, -1, 64), taken.reshape(n, -1), places, sizes


def _bytes(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of equally long values."""
    n, wide = rows.shape
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * wide), pa.py_buffer(np.ascontiguousarray(rows))])


# ---- whole trees -----------------------------------------------------------------------------------

def _numbered(rows: DataFrame, order: list[str], stage: Stage) -> DataFrame:
    """rows(tree, leaf, ...) with idx, the place by order and leaf within the tree, and n, the tree's size."""
    keys = ["tree", *order, "leaf", "row"]
    ranges = rows.withColumn("row", F.monotonically_increasing_id())
    ranges = stage.keep(stage.keep(ranges).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    held = ranges.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    trees = Window.partitionBy("tree")
    before = F.sum("rows").over(trees.orderBy("part")) - F.col("rows")
    held = held.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(trees).alias("n"))
    return ranges.withColumn("part", part).join(held, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / block))


def _in_order(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by("idx")


def _grow(nodes: DataFrame, fanout: int, depth: int, stage: Stage) -> list[DataFrame]:
    """The table of nodes, and the tables above it up to a single node for each tree."""
    block = fanout ** depth

    def above(key: tuple, group: pa.Table) -> pa.Table:
        n = group["n"][0].as_py()
        top = levels(matrix(_in_order(group)["leaf"]), fanout, depth if n > block else None)[-1]
        return pa.table({"tree": [key[0].as_py()], "idx": [key[1].as_py()], "leaf": [top.tobytes().decode()], "n": [-(-n // block)]})

    tables = [nodes]
    while len(tables) == 1 or not tables[-1].filter("n > 1").isEmpty():
        last = _blocks(tables[-1].select("tree", "idx", "leaf", "n"), block)
        tables.append(stage.keep(last.groupBy("tree", "block").applyInArrow(above, "tree string, idx long, leaf string, n long")))
    return tables


def _descend(tables: list[DataFrame], paths: DataFrame, fanout: int, depth: int, stage: Stage) -> DataFrame:
    """The lowest nodes with their proofs.  paths(tree, idx, ...) has those of the topmost."""
    block = fanout ** depth

    def below(names: list[str]):
        def each(key: tuple, group: pa.Table, path: pa.Table) -> pa.Table:
            group, path = _in_order(group), path.to_pylist()[0]
            n = group["n"][0].as_py()
            digests, taken, places, sizes = siblings(levels(matrix(group["leaf"]), fanout, depth if n > block else None), fanout)
            rows, rest = len(taken), np.frombuffer(path["proof"].encode(), np.uint8).reshape(-1, 64)
            taken = np.concatenate([taken, np.ones((rows, len(rest)), bool)], axis=1)
            digests = np.concatenate([digests, np.broadcast_to(rest, (rows, *rest.shape))], axis=1)
            ends = np.concatenate([[0], np.cumsum(taken.sum(axis=1) * 64)]).astype(np.int32)
            proof = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(ends), pa.py_buffer(digests[taken])])
            more = [np.concatenate([own, np.broadcast_to(np.frombuffer(path[name], np.uint8), (rows, len(path[name])))], axis=1) for own, name in ((places, "places"), (sizes, "sizes"))]
            out = {name: group[name] for name in names} | {"proof": proof, "places": _bytes(more[0], pa.binary()), "sizes": _bytes(more[1], pa.binary())}
            return pa.table(out | {name: pa.array([path[name]] * rows, pa.string()) for name in ("subroot", "root")})

        return each

    for nodes in reversed(tables[:-1]):
        names = [c for c in nodes.columns if c != "n"]
        schema = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in names) + ", " + PATH
        paths = _blocks(nodes, block).groupBy("tree", "block").cogroup(paths.groupBy("tree", "idx")).applyInArrow(below(names), schema)
        if nodes is not tables[0]:
            paths = stage.keep(paths)
    return paths


def merkle_manifest(leaves: DataFrame, tree: str, order: list[str], fanout: int = 2) -> DataFrame:
    """The columns of leaves(leaf, tree column, order columns, ...) with proof, places, sizes, subroot and root of each row (see PATH).

    Columns are carried as they are; none may be named as those that are added, or `tree`, `idx`, `n`, `row`, `at`, `part`, `shift`, `first`, `rows` or `block`."""
    if not 2 <= fanout <= 255:
        raise ValueError("fanout must be 2 to 255")
    own = {"tree", "idx", "n", "row", "at", "part", "shift", "first", "rows", "block", "proof", "places", "sizes", "subroot", "root"}
    if clash := own & set(leaves.columns):
        raise ValueError(f"leaves has columns named as the manifest's own: {sorted(clash)}")
    spark = leaves.sparkSession
    stage, depth = Stage(spark, "merkle"), max(1, int(np.log(BLOCK) / np.log(fanout) + 1e-9))
    named = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))  # nulls first, then by bytes
    nodes = stage.keep(_numbered(leaves.withColumn("tree", named), order, stage))
    groups = _grow(nodes, fanout, depth, stage)
    tops = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "leaf")
    whole = _grow(stage.keep(_numbered(tops, ["of"], stage)), fanout, depth, stage)
    empty = F.lit(b"")
    start = whole[-1].select("tree", "idx", F.lit("").alias("proof"), empty.alias("places"), empty.alias("sizes"), F.lit("").alias("subroot"), F.col("leaf").alias("root"))
    paths = _descend(whole, start, fanout, depth, stage)
    paths = stage.keep(paths.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", "places", "sizes", F.col("leaf").alias("subroot"), "root"))
    return _descend(groups, paths, fanout, depth, stage).drop("tree", "idx")


def fold(leaf: bytes, proof: bytes, places: bytes, sizes: bytes) -> str:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for place, size in zip(places, sizes, strict=True):
        left, right = proof[at:at + 64 * place], proof[at + 64 * place:at + 64 * (size - 1)]
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode()
        at += 64 * (size - 1)
    return leaf.decode()


def folded(manifest: DataFrame, leaf: str, out: str = "folded_root") -> DataFrame:
    """manifest with the root that the named leaf column and the row's proof lead to; equal to `root` if the row is as it was."""
    fields = [leaf, "proof", "places", "sizes"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(name).cast(pa.binary()).to_pylist() for name in fields]
            roots = pa.array([fold(*row) for row in zip(*columns, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, roots], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema) + f", `{out}` string"
    return manifest.mapInArrow(each, schema)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), *FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf_digest([more if name == "n_chars" else F.col(name) for name in FIELDS])
    leaves = docs.select("doc_id", "lang", leaf_digest([F.col(name) for name in FIELDS]).alias("leaf"), F.when(tampers, changed).alias("tampered"))
    manifest = merkle_manifest(leaves, "lang", ["doc_id"]).withColumn("tampered", F.coalesce("tampered", "leaf"))
    return (folded(manifest, "tampered")
            .select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql_leaf(n_chars: str) -> str:
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


#: CRC-32 by its definition, bit by bit; 3988292384 is its polynomial.
_CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))")
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_sql_leaf('n_chars::VARCHAR')} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_sql_leaf('(n_chars::HUGEINT + 1)::VARCHAR')} END AS tampered FROM documents),
d AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low AS (
  SELECT 0 AS t, tree, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM d
  UNION ALL
  SELECT t + 1, tree, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY t, tree, idx // 2),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx FROM low WHERE n = 1),
high AS (
  SELECT 0 AS t, idx, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT t + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY t, idx // 2),
sizes AS (SELECT DISTINCT t, tree, n FROM low WHERE n > 1),
tops AS (SELECT DISTINCT t, n FROM high WHERE n > 1),
places AS (
  SELECT d.id, s.t AS step, d.tree, (d.idx // (1 << s.t)) AS spot FROM d JOIN sizes s USING (tree)
  UNION ALL
  SELECT d.id, 100 + s.t, NULL, (r.idx // (1 << s.t)) FROM d JOIN subroots r USING (tree) CROSS JOIN tops s),
steps AS (
  SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY p.step) - 1 AS k, spot % 2 AS place, coalesce(l.h, u.h) AS sibling
  FROM places p LEFT JOIN low l ON l.tree = p.tree AND l.t = p.step AND l.idx = xor(p.spot, 1)
  LEFT JOIN high u ON u.t + 100 = p.step AND u.idx = xor(p.spot, 1)),
fold AS (
  SELECT id, 0 AS k, coalesce(tampered, leaf) AS h FROM d
  UNION ALL
  SELECT f.id, f.k + 1, sha256(CASE WHEN s.place = 1 THEN s.sibling || f.h ELSE f.h || coalesce(s.sibling, '') END) FROM fold f JOIN steps s ON s.id = f.id AND s.k = f.k),
ends AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, string_agg(sibling, '' ORDER BY k) AS proof FROM steps GROUP BY id)
SELECT d.doc_id, d.leaf, r.h AS subroot, w.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = w.h AS verified
FROM d JOIN subroots r USING (tree) JOIN ends e USING (id) LEFT JOIN proofs p USING (id) CROSS JOIN (SELECT h FROM high WHERE n = 1) w
"""
