"""N-gram Jaccard join of documents by a prefix-tree join, for links and their components.

Every document is its set of word n-grams in one global order, rare ones first.  Rarity comes from a
fixed-size count sketch over all documents, which only orders: any order gives the same links.

1. Documents with equal sets are one class from here on.
2. The ordered sets are paths of one prefix tree; linked sets must share one of their first n - ceil(t n) + 1 n-grams.
   Those are the tree's upper nodes and the keys by which it is dealt out: a node holds the classes that
   have its n-gram there.  Nodes of at most SMALL classes give all pairs that the overlap so far and the lengths that remain allow.
3. A larger node first gives each class PIVOTS pairs, with as many typical members of the node.  Nodes that then still
   hold several components, and more than BLOCK classes, are split by their branches: a class goes down to a child for each n-gram that may
   be its next common one, with one more n-gram of partial overlap, unless what remains can't reach the threshold, no
   other class is there, or all classes of the child share an earlier n-gram (their pairs are under that one).
   What is small enough, or still open after LEVELS branches, is paired in blocks of bounded size, never within a
   component, where another link changes nothing.
4. A parity sketch (its differing bits never outnumber the differing n-grams) drops pairs that can't reach
   the threshold.  The rest are checked exactly: a pivot's partners form a prefix tree of their whole ordered
   sets, walked once with the partial overlap of each path shared by all sets below; a subtree, known by its shortest and longest set, is
   cut where the overlap so far and the length that remains can't reach the threshold.

Sets hold 58 bits of hash for each n-gram, so two n-grams of one pair of texts are taken for one with odds of 1 to 2^58 for each pair of n-grams.

Null, empty and wordless texts have an empty set and link with nothing.  Repeated rows are equal sets.  A
null doc_id sorts last and gives a null component only where no member has an id.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, encoded, give_back_driver, in_tree, mix, ngrams, pair, sieve, small, span_hashes, table, words
from mosaiq.llm.components import components

LAST = 2**63 - 1
BUCKETS = 1 << 20
SMALL = 16
PIVOTS = 3
BLOCK = 256
#: Times that a node is split by its branches.
LEVELS = 2
#: Partners of a pivot in one prefix tree, and their n-grams.
TREE = 128
TREE_GRAMS = 1_000_000
PARITY = 8  # words of 64 bits


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct n-gram of the lower-cased texts, sorted."""
    data, starts, ends, first = words(texts, lower=True)
    h = span_hashes(data, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(texts)), count)
    grams = ngrams(h, size)
    inside = row[:len(grams)] == row[size - 1:size - 1 + len(grams)]
    rows, hashes = [row[:len(grams)][inside]], [grams[inside]]
    for r in np.flatnonzero((count > 0) & (count < size)):  # the whole sequence, told apart from n-grams by its length
        one = ngrams(h[first[r]:first[r + 1]], int(count[r]))
        rows.append(np.array([r]))
        hashes.append(pair(one, np.array([count[r]], np.uint64)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(6)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """A class of rarity for each bucket of n-grams: more for more frequent ones.  Counts cover all documents; they are
    summed in a tree of tasks, and only the classes, a byte each, come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in small(batches, "text"):
            n += np.bincount(_bucket(shingles(encoded(b.column("text")), size)[1]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([n.astype(np.int32 if n.max() < 2**31 else np.int64).tobytes()], pa.binary())], ["n"])

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column("n"):
                x = x.as_buffer()
                n += np.frombuffer(x, np.int32 if len(x) == 4 * BUCKETS else np.int64)
        return n

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([total(batches).tobytes()], pa.binary())], ["n"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_classes(total(batches)).tobytes()], pa.binary())], ["classes"])

    rows = in_tree(docs.select("text").mapInArrow(count, "n binary"), add, last=classes, schema="classes binary")
    return np.frombuffer(rows[0].classes, np.uint8) if rows else _classes(np.zeros(BUCKETS, np.int64))


def _classes(n: np.ndarray) -> np.ndarray:
    n = n.astype(float)
    return np.clip(np.round(4 * np.log2((n + 1) / (n.mean() + 1))) + 20, 0, 63).astype(np.uint8)


def ordered(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """n-grams as numbers in the global order: 6 bits of rarity, 58 bits of hash."""
    return (classes[_bucket(h)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))


def ordered_sets(texts: list[bytes], size: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after another in the global order, and where each begins (and the end)."""
    row, h = shingles(texts, size)
    t = ordered(h, classes)
    order = np.lexsort((t, row))
    return t[order], np.searchsorted(row, np.arange(len(texts) + 1))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _describe(size: int, percent: int, classes):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            t, at = ordered_sets(encoded(b.column("text")), size, classes.value)
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(t ^ np.uint64(k)), dtype=np.uint64)]) for k in (3, 5)]
                s = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
            first = np.minimum(n, np.where(n > 0, n - -(-percent * n // 100) + 1 + LEVELS, 0))
            prefix = t[(np.arange(len(t)) - at[row]) < first[row]]
            bit = mix(t) % np.uint64(64 * PARITY)
            bits = np.bincount(row * (64 * PARITY) + bit.astype(np.int64), minlength=len(n) * 64 * PARITY) & 1
            parity = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), b.column("key"), b.column("doc_id"), pa.array(n.astype(np.int64)), *map(pa.array, s),
                 _lists(prefix, np.concatenate([[0], np.cumsum(first)])), pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * PARITY).astype(np.int32)), pa.array(parity))],
                ["did", "key", "doc_id", "n", "s1", "s2", "prefix", "parity"])

    return describe


def needed(nx: Column, ny: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((nx + ny) * percent / (100 + percent) - 1e-9)


class Join:
    """The join of classes(rep, n, did, key, prefix, parity), a row for each distinct set.

    All joins are sort-merge joins by hint: both sides grow with the corpus, and over many small steps Spark's own
    broadcasts of sides that happen to be small would pile up in the driver."""

    def __init__(self, docs: DataFrame, classes: DataFrame, order, size: int, percent: int, stage: Stage):
        self.docs, self.classes, self.order, self.size, self.percent, self.stage = docs, classes, order, size, percent, stage
        self.spares: list[DataFrame] = []

    def _spare(self, df: DataFrame) -> DataFrame:
        """A table that is needed up to freed() alone."""
        self.spares.append(self.stage.keep(df))
        return self.spares[-1]

    def freed(self, df: DataFrame, since: int = 0) -> DataFrame:
        """df, written; the tables that it was made from, those after the first `since`, are deleted."""
        out = self.stage.keep(df)
        self.stage.drop(*self.spares[since:])
        del self.spares[since:]
        give_back_driver(self.stage.spark)
        return out

    def groups(self) -> DataFrame:
        """token, rep, n, pos, k (size of the group): the prefix n-grams that several classes share."""
        own = F.slice("prefix", 1, (F.col("n") - F.ceil(F.col("n") * self.percent / 100 - 1e-9) + 1).cast("int"))
        each = self.classes.select("rep", "n", F.posexplode(own).alias("pos", "token"))
        # Written first, here and below: a join right on top of its own aggregation could not be split at a hot key.
        shared = self._spare(each.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1"))
        return self.freed(each.join(shared.hint("merge"), "token"))

    def small_pairs(self, rows: DataFrame, shared: int = 1) -> DataFrame:
        """Pairs of rows(token, rep, n, pos) of a small node, that is one with `shared` common n-grams, whose last one stands at pos."""
        x = rows.select("token", *[F.col(c).alias(f"{c}_x") for c in ("rep", "n", "pos")])
        y = rows.select(F.col("token").alias("token_y"), *[F.col(c).alias(f"{c}_y") for c in ("rep", "n", "pos")])
        remain = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) + (shared - 1)
        likely = (100 * F.least("n_x", "n_y") >= self.percent * F.greatest("n_x", "n_y")) & (remain >= needed(F.col("n_x"), F.col("n_y"), self.percent))
        both = x.hint("merge").join(y.hint("merge"), (F.col("token") == F.col("token_y")) & (F.col("rep_x") < F.col("rep_y")) & likely)
        return both.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))

    def star_pairs(self, large: DataFrame) -> DataFrame:
        """Pairs of each class with the pivots of its groups: PIVOTS members with the fewest rarer n-grams before the group's.

        Of many near copies those have the fewest changes, so the others are likeliest to be linked with them."""
        # The n-grams before, then a hash: another one for each pivot.
        rows = large.select("token", "rep", "pos")
        least = [F.min(F.struct(F.col("pos"), F.xxhash64("rep", F.lit(k)).alias("mark"), F.col("rep")))["rep"] for k in range(PIVOTS)]
        pivot = self.stage.keep(rows.groupBy("token").agg(F.array_distinct(F.array(*least)).alias("pivots")).select("token", F.explode("pivots").alias("pivot")))
        pairs = rows.join(pivot.hint("merge"), "token").filter("rep <> pivot")
        return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))

    def unresolved(self, large: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the nodes that hold several components, with their label: token, rep, n, pos, k, label."""
        rows = (large.select("token", "rep", "n", "pos", "k").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
                .select("token", "rep", "n", "pos", "k", F.coalesce("label", "rep").alias("label")))
        return self._open(rows)

    def _open(self, rows: DataFrame) -> DataFrame:
        several = self._spare(rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("token"))
        return self.stage.keep(rows.join(several.hint("merge"), "token", "left_semi"))

    def split(self, rows: DataFrame, shared: int) -> DataFrame:
        """The branches of nodes(token, rep, n, pos, label) with `shared` common n-grams: rows of the same kind, with k."""
        since = len(self.spares)
        bounds = self._spare(rows.groupBy("token").agg(F.min("n").alias("shortest")))
        least = F.greatest("shortest", F.ceil(F.col("n") * self.percent / 100 - 1e-9))  # of the partners that may be there
        last = F.least(F.size("prefix"), (F.col("n") + shared - needed(F.col("n"), least, self.percent) + 1).cast("int"))
        each = (rows.select("token", "rep", "n", "pos", "label").join(bounds.hint("merge"), "token")
                .join(self.near.select("rep", "prefix").hint("merge"), "rep")
                .select("token", "rep", "n", "label", "pos", F.posexplode(F.slice("prefix", F.lit(1), F.greatest(F.lit(0), last))).alias("at", "gram")).filter("at > pos")
                .select(F.xxhash64("token", "gram").alias("token"), F.col("token").alias("node"), "rep", "n", "label", F.col("at").alias("pos")))
        counts = self._spare(each.groupBy("token").agg(F.count("*").alias("k"), F.min("label").alias("x"), F.max("label").alias("y")).filter("k > 1 AND x < y").select("token", "k"))
        live = self._spare(each.join(counts.hint("merge"), "token"))
        first = self._spare(live.groupBy("node", "rep").agg(F.min(F.struct("pos", "token"))["token"].alias("first")))
        # If all of a branch share an earlier one, their pairs are found there.
        kept = live.join(first.hint("merge"), ["node", "rep"]).groupBy("token").agg(F.min("first").alias("x"), F.max("first").alias("y")).filter("x <> y OR x = token").select("token")
        return self.freed(live.join(self._spare(kept).hint("merge"), "token", "left_semi").select("token", "rep", "n", "pos", "k", "label"), since)

    def descend(self, rows: DataFrame) -> DataFrame:
        """Pairs of all classes in unresolved nodes that are in different components and that the bounds and the sketch allow."""
        # Of all classes those in open nodes are few: they are fetched once.
        passes = sieve(rows.select(F.xxhash64("rep").alias("h")))
        near = self.classes.select("rep", "prefix", "parity").filter(passes(F.xxhash64("rep")))
        self.near = self._spare(near.join(rows.select("rep").hint("merge"), "rep", "left_semi"))
        # Each step's pairs are written before the next step is planned: in one plan all their shuffles would be open in the driver at once.
        out = self._spare(self.block_pairs(rows.filter(F.col("k") <= BLOCK)))
        large = rows.filter(F.col("k") > BLOCK)
        for shared in range(1, LEVELS + 1):
            if large.isEmpty():
                return out
            rows = self.split(large, shared)
            out = out.unionByName(self._spare(self.small_pairs(rows.filter(F.col("k") <= SMALL), shared + 1)))
            out = out.unionByName(self._spare(self.block_pairs(rows.filter((F.col("k") > SMALL) & (F.col("k") <= BLOCK)), shared + 1)))
            large = rows.filter(F.col("k") > BLOCK)
        return out.unionByName(self._spare(self.block_pairs(large, LEVELS + 1)))

    def block_pairs(self, rows: DataFrame, shared: int = 1) -> DataFrame:
        """All pairs of classes of a node with `shared` common n-grams that are in different components and pass the sketch, by pairs of blocks."""
        percent = self.percent

        def pairs(batch: pa.Table) -> pa.Table:
            rep, n, label, block = (batch.column(c).to_numpy() for c in ("rep", "n", "label", "block"))
            i, j = int(batch.column("i")[0].as_py()), int(batch.column("j")[0].as_py())
            bits = np.array(batch.column("parity").to_pylist(), np.int64).view(np.uint64).reshape(len(rep), PARITY)
            a, b = [], []
            for x in np.flatnonzero(block == i):
                ok = (block == j) & (label != label[x]) & (rep > rep[x] if i == j else True)
                ok &= 100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])
                y = np.flatnonzero(ok)
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
                y = y[apart <= n[y] + n[x] - 2 * -(-(n[y] + n[x]) * percent // (100 + percent))]
                a += [int(rep[x])] * len(y)
                b += rep[y].tolist()
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        counts = self._spare(rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("n").alias("shortest")))
        parity = self.near.select("rep", "parity")
        # What remains after a row's last common n-gram must do for the shortest partner that its node holds.
        least = needed(F.col("n"), F.greatest("shortest", F.ceil(F.col("n") * percent / 100 - 1e-9)), percent)
        rows = rows.join(counts.hint("merge"), "token").filter(F.col("n") - F.col("pos") + (shared - 1) >= least).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).join(parity.hint("merge"), "rep")
        rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        rows = rows.select("token", "rep", "n", "label", "parity", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        found = rows.groupBy("token", "i", "j").applyInArrow(pairs, "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, written."""
        side = lambda name: self.classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"p_{name}"))
        apart = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        n = F.col("n_a") + F.col("n_b")
        close = (100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")) & (apart <= n - 2 * needed(F.col("n_a"), F.col("n_b"), self.percent))
        likely = self._spare(pairs.distinct().join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter(close).select("a", "b", "n_b"))
        # Sides that turn up often become the roots, so that their texts travel once for many partners.
        sizes = F.greatest(F.ceil(F.count("*") / TREE), F.ceil(F.sum("n_b") / TREE_GRAMS))
        trees = self._spare(likely.groupBy("a").agg(sizes.alias("trees")))
        rooted = likely.join(trees.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("trees")).alias("tree"))
        wanted = rooted.select("a", "tree", F.col("b").alias("rep")).unionByName(rooted.select("a", "tree", F.col("a").alias("rep")).distinct())
        ids = self._spare(self.classes.select("rep", "did", "key").join(wanted.hint("merge"), "rep", "left_semi"))
        # Texts travel, not sets, which are larger.  Rows that repeat an id and a text give a text twice, which the tree takes as one.
        passes = sieve(ids.select(F.xxhash64("did", "key").alias("h")))
        texts = self.docs.select("did", "key", "text").filter(passes(F.xxhash64("did", "key"))).join(ids.hint("merge"), ["did", "key"]).select("rep", "text")
        return self.freed(wanted.join(texts.hint("merge"), "rep").groupBy("a", "tree").applyInArrow(self._trees(), "a long, b long"))

    def _trees(self):
        size, order, percent = self.size, self.order, self.percent

        def trees(rows: pa.Table) -> pa.Table:
            root, of = rows.column("a")[0].as_py(), {}
            for batch in small(iter(rows.to_batches()), "text"):
                t, at = ordered_sets(encoded(batch.column("text")), size, order.value)
                of.update(zip(batch.column("rep").to_pylist(), np.split(t, at[1:-1]), strict=True))
            own = of.pop(root)
            found = walk(own, sorted(of.items(), key=lambda x: x[1].astype(">u8").tobytes()), percent)
            return pa.table({"a": pa.array([root] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

        return trees


def walk(own: np.ndarray, sets: list[tuple[int, np.ndarray]], percent: int, stride: int = 64) -> list[int]:
    """Ids of the sets that are linked with own.  sets: id and ordered set, distinct and in order, so that the sets below a node of
    their prefix tree stand together: a node is a stretch of them, and their common path ends where the first and the last part."""
    found, lengths = [], np.array([len(s) for _, s in sets], np.int64)
    todo = [(0, len(sets), 0, 0)] if sets else []  # nodes: first set, end, depth, overlap with own down to there
    while todo:
        a, z, depth, shared = todo.pop()
        shortest, longest, path = int(lengths[a:z].min()), int(lengths[a:z].max()), sets[a][1]
        least = -(-(len(own) + shortest) * percent // (100 + percent))
        end = len(path)
        if z - a > 1:
            m = min(end, len(sets[z - 1][1]))
            differ = np.flatnonzero(path[depth:m] != sets[z - 1][1][depth:m])
            end = depth + int(differ[0]) if len(differ) else m
        while True:
            # n-grams of own that come before the path's last one can no longer be met.
            passed = int(np.searchsorted(own, path[depth - 1], "right")) if depth else 0
            cut = shared + min(longest - depth, len(own) - passed) < least
            if cut or depth == end:
                break
            part = path[depth:min(end, depth + stride)]
            shared += int((own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part).sum())
            depth += len(part)
        if cut:
            continue
        if lengths[a] == end:  # a set that ends at this node
            if shared >= -(-(len(own) + end) * percent // (100 + percent)):
                found.append(sets[a][0])
            a += 1
        if a < z:
            branch = np.array([s[end] for _, s in sets[a:z]], np.uint64)
            edges = a + np.concatenate([[0], np.flatnonzero(branch[1:] != branch[:-1]) + 1, [z - a]])
            todo += [(int(x), int(y), end, shared) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return found


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id: long, text): the smallest doc_id that links lead to.

    group names the component also where ids are null or repeated; text_key is xxhash64 of the text.  Two documents link if 100 * overlap >= percent * union of their sets of `size`-word n-grams."""
    spark = docs.sparkSession
    stage = Stage(spark, "ngram-join")
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("key"), "doc_id", "text")
    order = spark.sparkContext.broadcast(rarity(docs, size))
    schema = "did long, key long, doc_id long, n long, s1 long, s2 long, prefix array<long>, parity array<long>"
    rows = stage.keep(docs.mapInArrow(_describe(size, percent, order), schema).withColumn("nid", F.monotonically_increasing_id()))
    # A class is a distinct set; its rep is the row that stands for it.
    same = stage.keep(rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("nid").alias("rep"), F.min("did").alias("first")))
    classes = stage.keep(rows.join(same.select("rep").hint("merge"), F.col("nid") == F.col("rep"), "left_semi").drop("doc_id").withColumnRenamed("nid", "rep"))
    join = Join(docs, classes, order, size, percent, stage)
    groups = join.groups()
    large = groups.filter(F.col("k") > SMALL)
    links = join.links(join.small_pairs(groups.filter(F.col("k") <= SMALL)).unionByName(join.star_pairs(large)))
    labels = components(links, stage)
    left = join.unresolved(large, labels)
    stage.drop(groups)
    if not left.isEmpty():
        more = join.links(join.descend(left))
        if not more.isEmpty():  # the stars so far say what the links so far do, in fewer rows and rounds
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), stage)
    give_back_driver(spark)
    named = same.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", "first", F.coalesce("label", "rep").alias("label"))
    least = stage.keep(named.groupBy("label").agg(F.min("first").alias("component")))
    named = named.join(least.hint("merge"), "label").select("s1", "s2", "n", "label", "component")
    own = F.coalesce("component", "did")
    return (rows.select("nid", "did", "key", "doc_id", "n", "s1", "s2").join(named.hint("merge"), ["s1", "s2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(own != LAST, own).alias("component_id"), F.coalesce("label", "nid").alias("group"), F.col("key").alias("text_key")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_components(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), size=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(d, r) AS (SELECT DISTINCT x, x FROM sides UNION SELECT d, y FROM reach JOIN sides ON r = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) ON d = doc_id
"""
