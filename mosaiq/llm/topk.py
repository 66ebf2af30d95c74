"""Exact top-k search by inner product: a Voronoi join of queries and data.

Pivots are fitted on a bounded sample; they decide what is near what, never a result.  Each vector falls to the pivot at
the smallest angle.  A cell's vectors are summarised by rings of that angle: how many, and the least and largest part along the pivot's
direction and the largest part across it.  For a query with part u along that direction and v across it, no vector of the ring
can score more than max(u * least, u * largest) + v * across: the triangle inequality on the sphere, for vectors of any
length.  Rings are packed into blocks of bounded size (full ones are dealt out by row), queries of neighbouring cells into
groups of bounded size.  Each group first solves against a few blocks of its own cells.  The k-th scores found so far are its
queries' bounds: a block whose ring may still beat one of them is sent to the group, all others never travel.  Groups are solved
part by part, a bounded number of blocks at a time, and each part gives k rows for each query.

Equal vectors within a block are folded: of them only the k + 1 with the smallest ids can be among k best, since ties
go to the smaller id; so a vector that a third of all rows share costs no more than any other.

Scores are exact: products are formed in doubles while no partial sum can pass 2^53, else in whole numbers of
any length; a score beyond 64 bits counts as the nearest one within.  Vectors that are null or hold a null or non-finite component take
no part.  Vectors of different lengths are compared as if the shorter ended in zeros.  A query's own row is left out, rows
that repeat its id are not; null ids come last among ties.  An empty table, or one without queries, gives an empty result.
Further columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, only, table

#: Cells at most, and vectors of the sample for each of them.
CELLS, SAMPLE = 4096, 8
RINGS = 16
#: Vectors in a block and queries in a group, about; blocks of a group's own cells that are tried first; blocks in a part.
BLOCK, GROUP, HOME, PART = 4096, 4096, 4, 32
LAST = 2**63 - 1


# ---- vectors in tasks -----------------------------------------------------------------------------

def quantised(column: pa.ListArray | pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
    """floor(256 x) of each vector without nulls and non-finite components, and the rows that have one."""
    out, rows = [], []
    for k, v in enumerate(column.to_numpy(zero_copy_only=False)):
        if v is not None:
            v = np.asarray(v, np.float64) if not isinstance(v, list) else np.array([np.nan if x is None else x for x in v], np.float64)
            v = np.floor(256 * v)
            if np.isfinite(v).all():
                out.append(v)
                rows.append(k)
    return out, np.array(rows, np.int64)


def padded(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    if vectors and all(len(v) == dim for v in vectors):
        return np.stack(vectors)
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v[:dim]
    return out


def dumps(m: np.ndarray) -> bytes:
    """A matrix of whole numbers, two bytes each if they fit."""
    kind = "<i2" if not m.size or np.abs(m).max() < 2**15 else "<f8"
    return np.array([m.shape[1], kind == "<f8"], "<i4").tobytes() + m.astype(kind).tobytes()


def loads(data: bytes) -> np.ndarray:
    dim, wide = np.frombuffer(data, "<i4", 2)
    return np.frombuffer(data, "<f8" if wide else "<i2", -1, 8).astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (a, b))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exactly, within 64 bits."""
    a, b = widened(a, b)
    if not a.shape[1] or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Pivots:
    """Directions (unit vectors, in an order that keeps neighbours together)."""

    units: np.ndarray

    def parts(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and pivot the part along its direction and the part across it."""
        m = padded(list(m), self.units.shape[1]) if m.shape[1] < self.units.shape[1] else m
        along = m[:, :self.units.shape[1]] @ self.units.T
        # Components beyond the pivots' own lie across them all.
        return along, np.sqrt(np.maximum(0.0, (m * m).sum(axis=1)[:, None] - along * along))

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, rounds: int = 4) -> Pivots:
        """Spherical k-means on the sample, begun from its first rows."""
        long = np.sqrt((sample * sample).sum(axis=1))
        sample = sample[long > 0] / long[long > 0, None]
        if not len(sample):
            return cls(np.eye(1, max(1, sample.shape[1])))
        units = sample[:cells]
        for _ in range(rounds):
            near = (sample @ units.T).argmax(axis=1)
            sums = np.zeros_like(units)
            np.add.at(sums, near, sample)
            size = np.sqrt((sums * sums).sum(axis=1))
            units = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], units)
        return cls(units[_neighbours(units, np.arange(len(units)))])


def _neighbours(units: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows in an order that keeps near ones together: halved again and again across their widest direction."""
    if len(rows) <= 2:
        return rows
    own = units[rows] - units[rows].mean(axis=0)
    far = own[(own * own).sum(axis=1).argmax()]
    order = rows[np.argsort(own @ (far - own[((own - far) ** 2).sum(axis=1).argmax()]), kind="stable")]
    half = len(order) // 2
    return np.concatenate([_neighbours(units, order[:half]), _neighbours(units, order[half:])])


# ---- plan on the driver: a few numbers a cell and ring ---------------------------------------------

@dataclass
class Layout:
    """Blocks of data and groups of queries, by arithmetic on cell, ring and row."""

    first_block: np.ndarray  # (cell, ring): its first block
    blocks: np.ndarray  # (cell, ring): number of blocks
    first_group: np.ndarray  # by cell
    groups: np.ndarray  # by cell
    cell: np.ndarray  # by block run: cell of the ring
    low: np.ndarray  # by block run: least and largest part along, largest part across
    high: np.ndarray
    across: np.ndarray
    start: np.ndarray  # by block run: first block
    count: np.ndarray  # by block run: number of blocks

    @classmethod
    def of(cls, summary: list, cells: int, block: int, group: int) -> Layout:
        """summary: rows (cell, ring, n, queries, low, high, across).  Neighbouring rings of a cell with few rows make a block together, and so do queries of neighbouring cells a group."""
        first, blocks = np.zeros((cells, RINGS), np.int64), np.zeros((cells, RINGS), np.int64)
        asks = np.zeros(cells, np.int64)
        runs: list[list] = []
        for r in sorted(summary, key=lambda r: (r.cell, r.ring)):
            asks[r.cell] += r.queries
            if runs and runs[-1][0] == r.cell and runs[-1][1] + r.n <= block:
                last = runs[-1]
                last[1:5] = last[1] + r.n, min(last[2], r.low), max(last[3], r.high), max(last[4], r.across)
                last[5].append(r.ring)
            else:
                runs.append([r.cell, r.n, r.low, r.high, r.across, [r.ring]])
        count = np.array([-(-r[1] // block) for r in runs], np.int64)
        start = np.cumsum(count) - count
        for r, s, c in zip(runs, start, count, strict=True):
            first[r[0], r[5]], blocks[r[0], r[5]] = s, c
        before = np.cumsum(asks) - asks
        return cls(first, blocks, before // group, np.maximum(1, -(-asks // group)), *(np.array([r[k] for r in runs]) for k in (0, 2, 3, 4)), start, count)

    def home(self, cell: int, most: int) -> list[int]:
        """The first blocks of a cell."""
        return [int(s + k) for s, c in zip(self.start[self.cell == cell], self.count[self.cell == cell], strict=True) for k in range(c)][:most]


# ---- tasks -----------------------------------------------------------------------------------------

PLACED = "row long, vec_id long, asks boolean, vec binary, cell int, ring int, along double, across double"


def _place(pivots: Pivots):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                vectors, rows = quantised(b.column("embedding"))
                if not len(rows):
                    continue
                m = padded(vectors, max(map(len, vectors)))
                along, across = pivots.parts(m)
                cell = along.argmax(axis=1)
                pick = np.arange(len(rows))
                along, across = along[pick, cell], across[pick, cell]
                ring = np.minimum(RINGS - 1, np.floor(np.arctan2(across, along) / np.pi * RINGS)).astype(np.int32)
                own = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("vec_id"), own.column("asks"), pa.array([dumps(v[None]) for v in vectors], pa.binary()),
                                                  pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(along), pa.array(across)], ["row", "vec_id", "asks", "vec", "cell", "ring", "along", "across"])

    return place


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = [loads(v)[0] if len(v) > 8 else np.zeros(0) for v in column.to_pylist()]
    return padded(rows, max(map(len, rows)))


PACKED = "at int, rows array<long>, ids array<long>, data binary"


def _packed(at: int, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.Table:
    return pa.table({"at": pa.array([at], pa.int32()), "rows": [rows], "ids": [ids], "data": pa.array([dumps(m)], pa.binary())})


def _pack_block(k: int):
    def pack(key: tuple, group: pa.Table) -> pa.Table:
        """A block; of equal vectors only the k + 1 with the smallest ids."""
        m, ids, rows = _matrix(group["vec"]), group["vec_id"].fill_null(LAST).to_numpy(), group["row"].to_numpy()
        order = np.lexsort((rows, ids))
        m, ids, rows = m[order], ids[order], rows[order]
        _, same = np.unique(m, axis=0, return_inverse=True) if m.shape[1] else (None, np.zeros(len(m), np.int64))
        by = np.argsort(same.ravel(), kind="stable")
        first = np.flatnonzero(np.diff(same.ravel()[by], prepend=-1))
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        stay = np.sort(by[nth <= k])
        return _packed(key[0].as_py(), rows[stay], ids[stay], m[stay])

    return pack


def _pack_group(key: tuple, group: pa.Table) -> pa.Table:
    return _packed(key[0].as_py(), group["row"].to_numpy(), group["cell"].to_numpy().astype(np.int64), _matrix(group["vec"]))


FOUND = "ask long, id long, row long, score long"


def _solve(k: int):
    def solve(key: tuple, group: pa.Table, blocks: pa.Table) -> pa.Table:
        """The k best of the given blocks for each query of the group."""
        queries, asks = loads(group["data"][0].as_py()), group["rows"][0].values.to_numpy()
        queries = queries if len(queries) else np.zeros((len(asks), 0))
        best: list[tuple] = [()] * len(asks)
        for at in range(blocks.num_rows):
            rows, ids, m = blocks["rows"][at].values.to_numpy(), blocks["ids"][at].values.to_numpy(), loads(blocks["data"][at].as_py())
            m = m if len(m) else np.zeros((len(rows), 0))
            for a in range(0, len(asks), 256):
                s = scores(queries[a:a + 256], m)
                for j, own in enumerate(s):
                    # Rows stand by id: of equal scores at the edge the first ones go in.
                    least = np.partition(own, len(own) - k - 1)[len(own) - k - 1] if len(own) > k + 1 else own.min()
                    near = np.flatnonzero(own >= least)
                    near = near[np.argsort(-own[near], kind="stable")][:k + 1]
                    near = near[rows[near] != asks[a + j]]
                    if len(near):
                        held = [*best[a + j], *zip((-own[near]).tolist(), ids[near].tolist(), rows[near].tolist(), strict=True)]
                        best[a + j] = tuple(sorted(held)[:k])
        flat = [(asks[j], i, r, -s) for j, held in enumerate(best) for s, i, r in held]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("ask", "id", "row", "score"), columns, strict=True)})

    return solve


def _needed(pivots: Pivots, layout: Layout, home: int):
    def needed(key: tuple, group: pa.Table) -> pa.Table:
        """The blocks that may hold a better row for one of the group's queries, but for those that it has seen."""
        m, cells = loads(group["data"][0].as_py()), group["ids"][0].values.to_numpy()
        m = m if len(m) else np.zeros((len(cells), 0))
        place = {int(r): j for j, r in enumerate(group["rows"][0].values.to_numpy())}
        bound = np.full(len(cells), -np.inf)
        for x in group["bounds"][0].as_py() or []:
            bound[place[x["ask"]]] = x["score"]
        seen = {b for c in np.unique(cells) for b in layout.home(int(c), home)}
        wanted = np.zeros(len(layout.start), bool)
        for a in range(0, len(m), 256):
            along, across = pivots.parts(m[a:a + 256])
            u, v = along[:, layout.cell], across[:, layout.cell]
            most = np.maximum(u * layout.low, u * layout.high) + v * layout.across
            wanted |= (most + 1e-6 * (1 + np.abs(most)) >= bound[a:a + 256, None]).any(axis=0)
        blocks = [int(b) for s, c in zip(layout.start[wanted], layout.count[wanted], strict=True) for b in range(s, s + c) if b not in seen]
        return pa.table({"grp": pa.array([key[0].as_py()] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int32())})

    return needed


# ---- the join ----------------------------------------------------------------------------------------

def topk_join(vectors: DataFrame, asks: Column, k: int, cells: int | None = None, block: int = BLOCK, group: int = GROUP, home: int = HOME) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors(vec_id, embedding) for each row for which asks is true."""
    spark = vectors.sparkSession
    stage = Stage(spark, "topk")
    base = stage.keep(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), "embedding"))
    n = base.count()
    cells = cells or int(np.clip(np.ceil(np.sqrt(max(1, n))), 1, CELLS))
    picked = base.filter(F.pmod(F.xxhash64("row"), F.lit(n)) < SAMPLE * cells).select("embedding").toArrow() if n else None  # that many rows, about
    sample = quantised(picked["embedding"].combine_chunks())[0] if n else []
    pivots = Pivots.fit(padded(sample, max(map(len, sample), default=0)), cells)
    placed = stage.keep(base.mapInArrow(_place(pivots), PLACED))
    summary = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("queries"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")).collect()
    layout = Layout.of(summary, len(pivots.units), block, group)
    # Which block or group a row falls to: arithmetic on small tables of the cells and rings, at most cells x RINGS rows.
    rings = spark.createDataFrame([(c, r, int(layout.first_block[c, r]), int(layout.blocks[c, r])) for c, r in sorted({(x.cell, x.ring) for x in summary})], "cell int, ring int, first int, count int")
    owners = spark.createDataFrame([(c, int(layout.first_group[c]), int(layout.groups[c])) for c in range(len(layout.groups))], "cell int, first int, count int")
    spread = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("count"))).cast("int")
    blocks = stage.keep(placed.join(F.broadcast(rings), ["cell", "ring"]).withColumn("at", spread).select("at", "row", "vec_id", "vec").groupBy("at").applyInArrow(_pack_block(k), PACKED))
    queries = placed.filter("asks").join(F.broadcast(owners), "cell").withColumn("at", spread).select("at", "row", "cell", "vec")
    groups = stage.keep(queries.groupBy("at").applyInArrow(_pack_group, PACKED))
    homes = spark.createDataFrame([(c, b) for c in range(len(layout.groups)) for b in layout.home(c, home)], "cell int, block int")
    first = stage.keep(_solved(groups, groups.select(F.col("at").alias("grp"), F.explode(F.array_distinct("ids").cast("array<int>")).alias("cell")).join(homes, "cell").select("grp", "block").distinct(), blocks, k))
    member = groups.select(F.col("at").alias("grp"), F.explode("rows").alias("ask"))
    kth = first.groupBy("ask").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).filter(F.size("s") >= k).select("ask", F.col("s")[k - 1].alias("score"))  # k rows a part of the few first blocks
    bounds = member.join(kth, "ask").groupBy("grp").agg(F.collect_list(F.struct("ask", "score")).alias("bounds"))  # a group's own queries
    asked = groups.join(bounds.withColumnRenamed("grp", "at"), "at", "left")
    pairs = stage.keep(asked.groupBy("at").applyInArrow(_needed(pivots, layout, home), "grp int, block int"))
    found = first.unionByName(stage.keep(_solved(groups, pairs, blocks, k)))
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id", "row"))
    named = placed.filter("asks").select(F.col("row").alias("ask"), F.col("vec_id").alias("query_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(named, "ask").select("query_id", "rank", F.when(F.col("id") < LAST, F.col("id")).alias("vec_id"), "score")


def _solved(groups: DataFrame, pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The k best for each query in each part of its group's blocks, pairs(grp, block)."""
    pairs = pairs.withColumn("part", F.floor(F.col("block") / PART).cast("int"))
    left = pairs.select("grp", "part").distinct().join(groups.withColumnRenamed("at", "grp"), "grp")
    right = pairs.withColumnsRenamed({"grp": "for_grp", "part": "of_part"}).join(blocks.withColumnRenamed("at", "block"), "block")
    return left.groupBy("grp", "part").cogroup(right.groupBy("for_grp", "of_part")).applyInArrow(_solve(k), FOUND)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join(only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank
  FROM v q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM s WHERE rank <= 5
"""
