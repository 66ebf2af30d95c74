"""Phrase collocations, mined from count tries.

Each task counts the phrases of its texts in tries of limited depth, one for each language: a level holds the phrases of one
length, each as its parent in the level above, its last word and its count, sorted by words.  A trie is cut at
phrases that split a language into ranges of about equal size, and the serialised pieces of a range from all tasks meet
in one task, which merges these sorted runs level by level.  Where a language needs many ranges it is cut in several passes of few,
and the tries of a range are merged in between, so that the number of pieces grows as the text and not as its square.  Boundaries are phrases of any length, taken from
the tries themselves, so a first word (or pair of words) that starts a third of all phrases is split too.  A range whose boundary lies
below some word carries that word as well, for its count, so each merged trie has the ancestors of all its phrases.

Counts of left parts are read on the walk down the trie.  Right parts stand elsewhere: each candidate has a link to
each of them, and links are followed by a join on the phrase.

Null text is empty; a null language is `und`, together with rows whose language is that.  A table without words gives an empty
result.  Repeated rows count each.  Further columns of the table are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, encoded, give_back, only, small, table

#: Bytes of text that a task counts in one go.  Longer texts are counted in stretches that end where a piece ends.
FLUSH = 4_000_000
#: Bytes of serialised tries that are merged in one task, about, and ranges that one pass cuts a range into at most.
RANGE, FAN = 2_000_000, 256
#: Nodes that are held unmerged, about, where ranges are merged and before tries are cut; bytes of a range's tries that meet in one task between passes, about.
MERGED, HELD, DEALT = 1_000_000, 1_200_000, 8_000_000
#: Bytes of tries in a batch, about.
SENT = 1_000_000
#: A boundary is chosen from about so many phrases of the tries.
MARKS = 8
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(BREAKS)] = 1, 2


@dataclass
class Trie:
    """Counts of phrases.  words are sorted; a level's nodes are sorted by parent (place in the level above) and word (place in words)."""

    words: pa.Array
    parents: list[np.ndarray]
    ids: list[np.ndarray]
    counts: list[np.ndarray]

    def dumps(self) -> bytes:
        arrays = list(_lengths_and_bytes(self.words))
        for up, ids, counts in zip(self.parents, self.ids, self.counts, strict=True):
            arrays += [np.diff(up, prepend=0), ids, counts]
        out = [len(self.ids).to_bytes(1, "little")]
        for a in arrays:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
            out += [bytes([a.itemsize]), len(a).to_bytes(8, "little"), a.tobytes()]
        raw = b"".join(out)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def loads(cls, data: bytes) -> Trie:
        raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        arrays, at = [], 1
        for _ in range(2 + 3 * raw[0]):
            wide, n = raw[at], int.from_bytes(raw[at + 1:at + 9], "little")
            arrays.append(np.frombuffer(raw, f"u{wide}", n, at + 9).astype(np.int64 if arrays else np.int32))
            at += 9 + wide * n
        words = _binary(arrays[0], arrays[1].astype(np.uint8))
        return cls(words, [np.cumsum(a) for a in arrays[2::3]], arrays[3::3], arrays[4::3])

    def find(self, bound: list[bytes]) -> tuple[list[int], list[int]]:
        """By level the first node that does not come before the phrase `bound`, and the nodes of bound's own beginnings."""
        at, path, lo, hi, along = [], [], 0, len(self.ids[0]), True
        for d, ids in enumerate(self.ids):
            if d and along:
                lo, hi = np.searchsorted(self.parents[d], [path[-1], path[-1] + 1])
            elif d:
                at.append(int(np.searchsorted(self.parents[d], at[-1])))
                continue
            word = bisect.bisect_left(range(len(self.words)), bound[d], key=lambda k: self.words[k].as_py())
            k = int(lo + np.searchsorted(ids[lo:hi], word))
            along = d < len(bound) - 1 and k < hi and ids[k] == word and self.words[word].as_py() == bound[d]
            if along:
                path.append(k)
            at.append(k + along)
        return at, path

    def part(self, starts: list[int], ends: list[int], place: np.ndarray) -> Trie:
        """The nodes from starts to ends of each level, which must hold their parents.  place is room for a number a word."""
        ids = [x[a:z] for x, a, z in zip(self.ids, starts, ends, strict=True)]
        used = np.sort(np.concatenate(ids))  # not a walk over all words: most parts have few of them
        used = used[np.append(True, used[1:] != used[:-1])]
        place[used] = np.arange(len(used))
        ids = [place[x] for x in ids]
        parents = [x[a:z] - up for x, a, z, up in zip(self.parents, starts, ends, [0, *starts], strict=False)]
        return Trie(self.words.take(pa.array(used)), parents, ids, [x[a:z] for x, a, z in zip(self.counts, starts, ends, strict=True)])

    def cut(self, bounds: list[list[bytes]]) -> Iterator[tuple[int, Trie]]:
        """The parts between bounds, by number: 0 is before the first.  Each has the beginnings of its own lower bound too."""
        last, place = [len(x) for x in self.ids], np.empty(len(self.words), np.int64)
        places = [([0] * len(last), [])] + [self.find(b) for b in bounds]
        for k, (at, path) in enumerate(places):
            ends = places[k + 1][0] if k + 1 < len(places) else last
            starts = [a - (d < len(path)) for d, a in enumerate(at)]
            if starts != ends:
                yield k, self.part(starts, [max(z, a) for a, z in zip(at, ends, strict=True)], place)

    def marks(self, share: float, start: float) -> list[list[str]]:
        """Phrases at even steps, `share` of them on average.  start, from 0 to 1, is where in its step the first one stands."""
        sizes = np.cumsum([len(x) for x in self.ids])
        return [self.phrase(int(np.searchsorted(sizes, x, "right")), int(x)) for x in np.arange(start / share, sizes[-1], 1 / share).astype(np.int64)]

    def phrase(self, level: int, at: int) -> list[str]:
        """The words of the node with number `at` among all levels' nodes."""
        at -= sum(len(x) for x in self.ids[:level])
        out = []
        for d in range(level, -1, -1):
            out.append(self.words[int(self.ids[d][at])].as_py().decode())
            at = int(self.parents[d][at])
        return out[::-1]


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _lengths_and_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of _binary, off the array's buffers."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0]:at[-1]]


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, sorted, and each word's place among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def count_phrases(texts: list[bytes], depth: int) -> Trie | None:
    """The trie of the phrases of up to `depth` words; none if there are no words."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)  # bytes.lower() folds A-Z alone
    kind = _KIND[data]
    gap = kind > 0
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return None
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    words, ids = _ranked(_binary(ends - starts, data[~gap]))
    del data, kind, gap, edge, starts, ends
    out = Trie(words, [np.zeros(len(words), np.int64)], [np.arange(len(words))], [np.bincount(ids)])
    node, first = ids, np.arange(len(ids))
    for d in range(1, depth):
        stays = first < len(ids) - d
        stays[stays] = piece[first[stays] + d] == piece[first[stays]]
        node, first = node[stays], first[stays]
        keys, node, counts = np.unique(node << 32 | ids[first + d], return_inverse=True, return_counts=True)
        out.parents.append(keys >> 32)
        out.ids.append(keys & 0xFFFFFFFF)
        out.counts.append(counts)
    return out


def merge(tries: list[Trie]) -> Trie:
    """One trie of all counts: equal keys are added up level by level, in any order."""
    words, place = _ranked(pa.concat_arrays([t.words for t in tries]))
    edges = np.cumsum([0, *(len(t.words) for t in tries)])
    out = Trie(words, [], [], [])
    node = np.zeros(1, np.int64)  # of each node of the level before, in all tries one after the other: its place when merged
    above = np.zeros(len(tries), np.int64)
    for d in range(len(tries[0].ids)):
        ids = np.concatenate([place[a + t.ids[d]] for a, t in zip(edges, tries, strict=False)])
        parents = node[np.concatenate([t.parents[d] + a for a, t in zip(above, tries, strict=True)])]
        keys = parents << 32 | ids
        order = np.argsort(keys)
        keys = keys[order]
        fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
        node = np.empty(len(keys), np.int64)
        node[order] = np.cumsum(fresh) - 1
        counts = np.concatenate([t.counts[d] for t in tries])[order]
        above = np.cumsum([0, *(len(t.ids[d]) for t in tries)])[:-1]
        out.parents.append(keys[fresh] >> 32)
        out.ids.append(keys[fresh] & 0xFFFFFFFF)
        out.counts.append(np.add.reduceat(counts, np.flatnonzero(fresh)) if len(keys) else counts)
    return out


# ---- tasks ------------------------------------------------------------------------------------

TRIES = "lang string, lo array<string>, n long, size long, trie binary, marks array<array<string>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    words = pa.list_(pa.string())
    kinds = [pa.string(), words, pa.int64(), pa.int64(), pa.binary(), pa.list_(words)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "lo", "n", "size", "trie", "marks"])


def _row(lang: str, lo: list[str] | None, n: int, trie: Trie, room: int) -> tuple:
    data = trie.dumps()
    share = min(1.0, MARKS * len(data) / room / sum(len(x) for x in trie.ids)) if room else 0.0
    return lang, lo, n, len(data), data, trie.marks(share, zlib.crc32(data) / 2**32) if share else None


def _stretches(text: bytes, most: int) -> Iterator[bytes]:
    """The text, cut where pieces end if it is longer than `most`."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(bytes([c]), at, at + most) for c in BREAKS)
        if end <= at:  # no end of a piece within: the next one
            end = min((k for c in BREAKS if (k := text.find(bytes([c]), at + most)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def _count(depth: int, flush: int, room: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                if trie := count_phrases(texts, depth):
                    yield _batch([_row(lang, None, int(trie.counts[0].sum()), trie, room)])
            held.clear()

        for b in small(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), encoded(b.column("text")), strict=True):
                for part in _stretches(text, flush):
                    held.setdefault(lang, []).append(part)
                    size += len(part) + 1
                    if size > flush:
                        yield from out()
                        size = 0
        yield from out()

    return count


def _cut(room: int, most: int = HELD):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list[Trie]]] = {}
        size = 0

        def parts() -> Iterator[tuple]:
            for (lang, lo), (bounds, tries) in held.items():
                trie = merge(tries) if len(tries) > 1 else tries[0]
                tries.clear()
                for k, part in trie.cut([[w.encode() for w in x] for x in bounds]):
                    yield _row(lang, bounds[k - 1] if k else lo and list(lo), 0, part, room)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            rows, sent = [], 0
            for row in parts():
                rows.append(row)
                sent += row[3]
                if sent > SENT:
                    yield _batch(rows)
                    rows, sent = [], 0
            if rows:
                yield _batch(rows)

        for b in small(batches, "trie"):
            for row in b.to_pylist():
                trie = Trie.loads(row["trie"])
                # Tries of one range are merged before they are cut: fewer pieces, which share their words.
                held.setdefault((row["lang"], row["lo"] and tuple(row["lo"])), (row["bounds"] or [], []))[1].append(trie)
                size += sum(len(x) for x in trie.ids)
                if size > most:
                    yield from out()
                    size = 0
        yield from out()

    return cut


def _joined(words: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    parts = [words.take(pa.array(x)).cast(pa.string()) for x in ids]
    return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def _lists(columns: list[pa.Array], n: int, kind: pa.DataType) -> pa.Array:
    """For each of n rows the list of its values in the columns."""
    wide = len(columns)
    values = pc.take(pa.concat_arrays(columns), pa.array(np.arange(n * wide).reshape(wide, n).T.ravel())) if wide else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), values)


def _merged(least: int):
    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        """The phrases of a range that occur `least` times or more."""
        held: list[Trie] = []
        size, most = 0, MERGED
        for data in rows["trie"]:
            held.append(Trie.loads(data.as_py()))
            size += len(held[-1].ids[-1])
            if size > most:  # a bounded number of nodes at a time, each node merged a few times alone
                held = [merge(held)]
                size = len(held[0].ids[-1])
                most = max(MERGED, 2 * size)
        trie = merge(held)
        lo = [w.encode() for w in key[1].as_py() or []]
        own = trie.find(lo)[1] if lo else []  # lo's beginnings belong to ranges before
        out = []
        for d, counts in enumerate(trie.counts):
            at = np.flatnonzero(counts >= least)
            at = at[at != own[d]] if d < len(own) else at
            walk, ids, seen = at, [], []
            for up in range(d, -1, -1):
                ids.append(trie.ids[up][walk])
                seen.append(trie.counts[up][walk])
                walk = trie.parents[up][walk]
            ids, seen = ids[::-1], seen[::-1]
            n, link = len(at), pa.struct([("l", pa.int64()), ("right", pa.string())])
            links = [pa.StructArray.from_arrays([pa.array(left), _joined(trie.words, ids[k + 1:])], fields=list(link)) for k, left in enumerate(seen[:-1])]
            inside = [_joined(trie.words, ids[a:a + m]) for m in range(2, d + 1) for a in range(d + 2 - m)]
            out.append(pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "phrase": _joined(trie.words, ids), "size": pa.array([d + 1] * n, pa.int32()), "a": pa.array(seen[-1]),
                                 "links": _lists(links, n, link), "inside": _lists(inside, n, pa.string())}))
        give_back()
        return pa.concat_tables(out)

    return merged


PHRASES = "lang string, phrase string, size int, a long, links array<struct<l: long, right: string>>, inside array<string>"


def phrase_counts(docs: DataFrame, stage: Stage, depth: int = 3, least: int = 10, flush: int = FLUSH, room: int = RANGE, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a, links, inside) of all phrases that occur `least` times in docs(text, lang), and (lang, n) of all languages.

    links has for each cut of the phrase the count of its left part and the right part itself; inside has its shorter phrases of two words and more."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    tries = stage.keep(docs.select(lang.alias("lang"), "text").mapInArrow(_count(depth, flush, room), TRIES))
    words = stage.keep(tries.groupBy("lang").agg(F.sum("n").alias("n")))
    largest = None
    while True:
        sizes = tries.groupBy("lang", "lo").agg(F.sum("size").alias("bytes"))
        most, total = (x or 0 for x in sizes.agg(F.max("bytes"), F.sum("bytes")).first())
        passes = 1
        while most > room * fan**passes:
            passes += 1
        last = passes == 1 or most == largest
        # The passes share the work evenly: with n of them left each cuts into the n-th root of the ranges that are wanted in the end.
        goal = room if last else most / math.ceil((most / room) ** (1 / passes))
        # A range's boundaries come from its tries' marks; more marks than needed are thinned by their hash.
        wanted = F.least(F.lit(fan), F.ceil(F.col("bytes") / goal))
        marks = tries.select("lang", "lo", F.explode("marks").alias("mark"), F.monotonically_increasing_id().alias("at")).join(sizes.filter(F.col("bytes") > goal).withColumnsRenamed({"lang": "of", "lo": "from"}), (F.col("lang") == F.col("of")) & F.col("lo").eqNullSafe(F.col("from")))
        thin = F.pmod(F.xxhash64("mark", "at"), F.lit(1 << 20)) < (1 << 20) * F.least(F.lit(1.0), wanted * room / F.col("bytes"))
        marks = marks.filter(thin).groupBy("of", "from").agg(F.array_sort(F.collect_list("mark")).alias("marks"), F.max(wanted).alias("wanted"))
        picked = F.expr("array_distinct(transform(sequence(1, cast(wanted AS int) - 1), k -> element_at(marks, 1 + cast(k * size(marks) div wanted AS int))))")
        bounds = stage.keep(marks.select("of", "from", picked.alias("bounds")).withColumn("bounds", F.filter("bounds", lambda b: F.col("from").isNull() | (b > F.col("from")))))
        cut = (tries.join(bounds, (F.col("lang") == F.col("of")) & F.col("lo").eqNullSafe(F.col("from")), "left").select("lang", "lo", "n", "trie", "bounds")
               .mapInArrow(_cut(0 if last else room), TRIES))  # the last pass needs no marks
        if last:
            break
        # The tries of a range stand together in a few tasks, so that the next pass merges them before it cuts.
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(math.ceil(goal / DEALT)))
        cut = cut.withColumn("dealt", dealt).repartition(math.ceil(total / DEALT), "lang", "lo", "dealt").drop("dealt").sortWithinPartitions("lang", "lo")
        before, largest, tries = tries, most, stage.keep(cut)
        stage.drop(before)
    counts = stage.keep(cut.select("lang", "lo", "trie").groupBy("lang", "lo").applyInArrow(_merged(least), PHRASES))
    stage.drop(tries)
    return counts, words


def collocations(docs: DataFrame, depth: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `depth` words.

    A phrase counts if it occurs `least` times and no longer one that holds it has `share` per cent of its occurrences.
    Its score is the least, over its cuts in two, of floor(10^6 a^2 / (l r)), in decimals of 38 digits: exact up to counts of 10^16."""
    stage = Stage(docs.sparkSession, "phrases", free=True)
    counts, words = phrase_counts(docs, stage, depth, least)
    known = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    links = counts.filter("size > 1").select("lang", "phrase", "a", F.posexplode("links").alias("k", "link")).select("lang", "phrase", "a", "k", "link.*")
    score = F.expr("(cast(a AS decimal(38,0)) * a * 1000000) div (cast(l AS decimal(38,0)) * r)")
    scored = links.join(known, ["lang", "right"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = counts.filter("size > 2").select("lang", F.explode("inside").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # A language's best are found in shares first, so that the last task of a language gets `top` rows of each share and not all its phrases.
    shares = F.pmod(F.xxhash64("phrase"), F.lit(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    best = kept.withColumn("share", shares)
    for keys in (["lang", "share"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(only(table(spark, sf_dir, "documents"), "text", "lang"))
    return found.withColumn("rank", F.col("rank").cast("long"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 4) t(m)),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.m, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM c, range(1, 3) t(k) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ') WHERE k < c.m),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""
