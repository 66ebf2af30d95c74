"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the bag of its hashed character n-grams and itself; a window of words is the average of its
words' bags of embeddings, and a linear softmax over that average gives the probability of toxic.
Embeddings and softmax are trained together in numpy, so a misspelling that was never seen still shares
most of its n-gram vectors with the word it hides.  A text is cut into overlapping windows, all of them
scored, and a text is as toxic as its most toxic window: in a long text one insult would vanish in the
average of the whole.  Words end at white space and punctuation of any script.  A run of more than RUN bytes without
any (text of a script that sets no spaces, glued words) counts as several words: overlapping pieces about as long as
words are, in which every n-gram of the run stands.  Training knows labels of whole texts only: at first all windows of a text count for it, then its highest one and those that look toxic.  A last
logistic step, fitted on texts kept apart, maps the highest window's score to a probability.

The model is fitted on a bounded sample: `most` labelled texts of each class at most, those with the
smallest hash of doc_id, and of them in that order as many as have `most_bytes` bytes together; no text is cut.  Scoring covers whole texts.  Of
different texts with one labelled id, the one with the smallest hash is taken.  A subword is learned if three texts of the sample have it,
however large the sample is; the decay holds back rare ones.

Null and wordless texts have score BLANK.  Repeated rows score alike.  Rows without a label, with conflicting
labels or a null id are never learned from.  Without labels of both classes every score is BLANK.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import Stage, encoded, give_back, mix, pair, small, span_hashes, table

BLANK = 0.01
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
WINDOW, STEP = 6, 3
#: Bytes of the longest run that is one word, and of the pieces of a longer one.
RUN, PIECE = 40, 12


def word_table() -> np.ndarray:
    """Bytes that words are made of: letters, digits and all of UTF-8 beyond ASCII, save what between() finds."""
    b = np.arange(256)
    return (b >= 128) | np.isin(b, list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


_WORD = word_table()
_between: list[np.ndarray] = []


def between_table() -> np.ndarray:
    """Code points that end words: separators, punctuation, control and format characters (zero-width ones among them)."""
    if not _between:
        kinds = map(unicodedata.category, map(chr, range(0x110000)))
        _between.append(np.fromiter((c[0] in "ZP" or c in ("Cc", "Cf") for c in kinds), bool, 0x110000))
    return _between[0]


def between(data: np.ndarray) -> np.ndarray:
    """Places of the bytes of non-ASCII characters that end words."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return lead
    first = data[lead]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = (first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))).astype(np.int64)
    whole = lead + size <= len(data)
    for k in (1, 2, 3):
        more = data[np.minimum(lead + k, len(data) - 1)]
        code = np.where(k < size, code << 6 | more & 0x3F, code)
        whole &= (k >= size) | (more & 0xC0 == 0x80)  # a broken character ends nothing
    whole &= code < 0x110000
    ends = between_table()[np.where(whole, code, ord("a"))]
    lead, size = lead[ends], size[ends]
    return np.concatenate([(lead + k)[k < size] for k in range(4)])


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    gap = np.concatenate([[True], ~_WORD[data]])
    gap[between(data) + 1] = True
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, at)


def pieces(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """split_words' words with long runs cut up: starts, ends, how many of its two ends a word lacks (1: first, 2: last, 3: both), first word of each text."""
    step = PIECE - max(GRAMS) + 1
    n = ends - starts
    count = np.where(n > RUN, -(-(n - PIECE) // step) + 1, 1)
    at = np.concatenate([[0], np.cumsum(count)])
    run = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(run)) - at[run]
    s = starts[run] + k * step
    last = k == count[run] - 1
    return s, np.where(last, ends[run], s + PIECE), (k > 0) + 2 * ~last, at[first]


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subword buckets of the distinct words, the distinct word of each bucket entry, the distinct word of each word, first word of each text."""
    data, starts, ends, first = split_words(texts)
    starts, ends, lacks, first = pieces(starts, ends, first)
    h = span_hashes(data, starts, ends)
    h[lacks > 0] = mix(h[lacks > 0] + lacks[lacks > 0].astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    s, n, lacks = starts[one], ends[one] - starts[one], lacks[one]
    opens, closes = lacks & 1 == 0, lacks & 2 == 0
    # Marked words, one after another: < w o r d >, the marks at the ends of runs alone.
    size = n + opens + closes
    at = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(s), dtype=np.int32), size)
    place = np.arange(int(size.sum())) - at[owner]
    byte = data[np.clip(s[owner] + place - opens[owner], 0, len(data) - 1)].astype(np.uint64)
    byte[at[opens]] = 1
    byte[(at + size - 1)[closes]] = 2
    bucket = lambda x: (x & np.uint64(BUCKETS - 1)).astype(np.int32)
    buckets, owners = [bucket(h[one])], [np.arange(len(s), dtype=np.int32)]
    level = mix(byte + np.uint64(99))
    seed = level
    for k in range(2, max(GRAMS) + 1):
        level = pair(level[:-1], seed[k - 1:]) if len(level) else level
        if k in GRAMS and len(level):
            inside = owner[:len(level)] == owner[k - 1:]
            buckets.append(bucket(level[inside]))
            owners.append(owner[:len(level)][inside])
    return np.concatenate(buckets), np.concatenate(owners), which.reshape(-1), first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of every window: WINDOW words, STEP apart; the last one ends with the text."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(k * STEP + WINDOW, n[text])
    start = np.maximum(0, end - WINDOW)
    return text, first[text] + start, first[text] + end


@dataclass
class ToxicModel:
    """weights: the softmax's log odds of each subword bucket, that is embedding times the difference of the two classes' vectors."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    blank: bool = False

    def text_logits(self, texts: list[bytes]) -> np.ndarray:
        """The largest window logit of each text; -inf without words."""
        buckets, owner, which, first = distinct_words(texts)
        out = np.full(len(texts), -np.inf)
        if not len(which):
            return out
        n = np.bincount(owner)
        word = np.bincount(owner, self.weights[buckets]) / n
        run = np.concatenate([[0.0], np.cumsum(word[which])])
        text, a, z = windows(first)
        np.maximum.at(out, text, (run[z] - run[a]) / (z - a) + self.bias)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.blank:
            return np.full(len(texts), BLANK)
        logit = self.text_logits(texts)
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(logit), 1 / (1 + np.exp(-(self.scale * logit + self.shift))), BLANK)


@dataclass
class _Bags:
    """Texts as windows of words, words as bags of the subwords that enough texts share."""

    which: np.ndarray  # distinct word of each word
    owner: np.ndarray  # distinct word of each subword entry
    slot: np.ndarray  # trained subword of each entry
    used: np.ndarray  # bucket of each trained subword
    n_sub: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(texts: list[bytes], least: int) -> _Bags:
    buckets, owner, which, first = distinct_words(texts)
    n_sub = np.bincount(owner)
    text, start, end = windows(first)
    # In how many texts does each bucket occur?  A few texts at a time, as each has all subwords of all its words.
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(n_sub) + 1))
    seen = np.zeros(BUCKETS, np.int64)
    for k in range(len(texts)):
        word = np.unique(which[first[k]:first[k + 1]])
        n = begin[word + 1] - begin[word]
        entry = order[np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        seen[np.unique(buckets[entry])] += 1
    enough = seen >= least
    kept = enough[buckets]
    used, slot = np.flatnonzero(enough), (np.cumsum(enough) - 1).astype(np.int32)[buckets[kept]]
    return _Bags(which.astype(np.int32), owner[kept], slot, used, n_sub, text, start, end)


def fit(texts: list[bytes], labels: np.ndarray, dims: int = 8, rounds: tuple[int, int] = (20, 40), rate: float = 0.1, decay: float = 3e-4, least: int = 3, seed: int = 5) -> ToxicModel:
    """Full-batch Adam on embeddings and softmax: first on all windows of a text, then on its highest window and,
    in a toxic text, on all that look toxic by now, so that none of its insults is forgotten for a plainer one."""
    b = bags(texts, least)
    n_words, size, y = len(b.n_sub), (b.end - b.start).astype(float), labels.astype(float)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(b.used), dims)), rng.normal(0, 0.5, (2, dims)), np.zeros(2)]
    emb, out, bias = params
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(np.unique(b.text))
    texts_with = np.unique(b.text)
    n_windows = np.bincount(b.text, minlength=len(texts))
    for t in range(1, sum(rounds) + 1):
        way = out[1] - out[0]
        word = np.column_stack([np.bincount(b.owner, emb[b.slot, k], n_words) for k in range(dims)]) / b.n_sub[:, None]
        run = np.concatenate([[0.0], np.cumsum((word @ way)[b.which])])
        logit = WINDOW * (run[b.end] - run[b.start]) / size + bias[1] - bias[0]
        if t <= rounds[0]:
            w, weight = slice(None), balance[b.text] / n_windows[b.text]
        else:
            rank = np.lexsort((logit, b.text))
            chosen = np.zeros(len(logit), bool)
            chosen[rank[np.searchsorted(b.text[rank], texts_with, "right") - 1]] = True
            chosen |= (logit > 0) & (y[b.text] == 1)
            w = np.flatnonzero(chosen)
            weight = balance[b.text[w]] / np.bincount(b.text[w], minlength=len(texts))[b.text[w]]
        g = (1 / (1 + np.exp(-np.clip(logit[w], -30, 30))) - y[b.text[w]]) * weight
        change = np.zeros(len(b.which) + 1)
        np.add.at(change, b.start[w], WINDOW * g / size[w])
        np.add.at(change, b.end[w], -WINDOW * g / size[w])
        by_word = np.bincount(b.which, np.cumsum(change)[:-1], n_words)
        average = by_word @ word
        by_slot = np.bincount(b.slot, (by_word / b.n_sub)[b.owner], len(b.used))
        grads = [by_slot[:, None] * way + decay * emb, np.stack([-average, average]) + decay * out, np.array([-g.sum(), g.sum()])]
        for x, grad, (m, v) in zip(params, grads, state, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[b.used] = WINDOW * (emb @ (out[1] - out[0]))
    return ToxicModel(weights, float(bias[1] - bias[0]))


def calibrate(model: ToxicModel, texts: list[bytes], labels: np.ndarray, toxic_share: float) -> None:
    """A logistic step from the largest logit to the probability, at the share of toxic texts among all labelled ones."""
    x = model.text_logits(texts)
    ok = np.isfinite(x)
    x, y = x[ok], labels[ok].astype(float)
    if not len(x) or y.min() == y.max():
        return
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    target = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    mean, spread = x.mean(), x.std() + 1e-9
    x = (x - mean) / spread
    k = np.array([1.0, 0.0])
    for _ in range(100):  # damped Newton
        q = 1 / (1 + np.exp(-np.clip(k[0] * x + k[1], -30, 30)))
        h = weight * q * (1 - q)
        grad = np.array([(weight * (q - target) * x).sum() + 0.01 * k[0], (weight * (q - target)).sum()])
        hess = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        k -= np.clip(step, -1, 1)
        if abs(step).max() < 1e-7:
            break
    model.scale, model.shift = float(max(k[0], 0) / spread), float(k[1] - max(k[0], 0) * mean / spread)


def train(texts: list[bytes], labels: np.ndarray, toxic_share: float | None = None) -> ToxicModel:
    """A model of the texts, every fifth of which is kept for calibration."""
    if not texts or labels.min() == labels.max():
        return ToxicModel(np.zeros(BUCKETS), 0.0, blank=True)
    order = np.argsort(labels, kind="stable")  # so that each class gives a fifth
    apart = np.zeros(len(texts), bool)
    apart[order[::5]] = True
    if min(labels.sum(), (1 - labels).sum()) < 5:  # too few to set any apart: all are learned from, and calibrate
        model = fit(texts, labels)
        calibrate(model, texts, labels, labels.mean() if toxic_share is None else toxic_share)
        return model
    part = [[t for t, k in zip(texts, apart, strict=True) if k == want] for want in (False, True)]
    if labels[~apart].min() == labels[~apart].max() or not any(t.strip() for t in part[0]):
        return ToxicModel(np.zeros(BUCKETS), 0.0, blank=True)
    model = fit(part[0], labels[~apart])
    calibrate(model, part[1], labels[apart], labels.mean() if toxic_share is None else toxic_share)
    return model


def _fitting(rows: list, most_bytes: int) -> list[tuple]:
    """The rows(doc_id, toxic, bytes, h) of each class that fit, in order of h, each with whether its text must be cut."""
    out = []
    for toxic in (0, 1):
        own = sorted((r for r in rows if r.toxic == toxic), key=lambda r: (r.h, r.doc_id))
        left, fits = most_bytes, []
        for r in own:
            if r.bytes <= left:
                left -= r.bytes
                fits.append((r, False))
        out += fits or [(r, True) for r in sorted(own, key=lambda r: (r.bytes, r.h))[:1]]
    return out


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: int = 1500, most_bytes: int = 32_000_000) -> ToxicModel:
    """Fits on texts of docs(doc_id, text) that labels(doc_id, toxic) marks: `most` of each class at most, with `most_bytes` bytes at most.

    Texts are taken by the hash of their ids; one that does not fit into what is left of the bytes is passed over, and the next one tried.
    Where none of a class fits, its shortest text is read in stretches spread over all of it."""
    stage = Stage(docs.sparkSession, "toxicity")
    clear = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    near = lambda y: clear.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic")
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("key"))
    # At most 2 * most rows, so they are broadcast, and their sizes go through the driver.
    marked = F.broadcast(stage.keep(near(0).unionByName(near(1))))
    sized = texts.join(marked, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("key", F.octet_length("text").cast("long").alias("bytes"))).alias("t"))
    rows = sized.select("doc_id", "toxic", "t.key", "t.bytes", F.xxhash64("doc_id").alias("h")).collect()
    picked = [(r.doc_id, r.toxic, r.key, cut) for r, cut in _fitting(rows, most_bytes)]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic {labels.schema['toxic'].dataType.simpleString()}, key long, cut boolean"
    fits = F.broadcast(docs.sparkSession.createDataFrame(picked, kinds))
    n = max(1, most_bytes // 4000)  # stretches of 1,000 characters, of 4 bytes each at most
    spread = F.expr(f"array_join(transform(sequence(0, {n - 1}), k -> substr(text, cast(1 + k * (length(text) / {n}) AS int), 1000)), ' ')")
    sample = texts.join(fits, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "toxic", F.when(F.col("cut"), spread).otherwise(F.col("text")).alias("text"))
    share = clear.agg(F.avg("toxic")).first()[0]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column("doc_id").to_pylist(), encoded(b.column("text")), b.column("toxic").to_pylist(), strict=True))
        m = train([t for _, t, _ in rows], np.array([y for *_, y in rows], np.int64), share)
        del rows
        give_back()
        yield pa.RecordBatch.from_pylist([{"weights": m.weights.tobytes(), "bias": m.bias, "scale": m.scale, "shift": m.shift, "blank": m.blank}])

    # The sample is bounded, so one task can hold it; the driver gets the model alone.
    m = sample.repartition(1).mapInArrow(task, "weights binary, bias double, scale double, shift double, blank boolean").first()
    return ToxicModel(np.frombuffer(m.weights), m.bias, m.scale, m.shift, m.blank) if m else ToxicModel(np.zeros(BUCKETS), 0.0, blank=True)


def score_toxicity(docs: DataFrame, model: ToxicModel, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs, whatever its columns, with the score of its text added under a name that it does not have yet.

    keep: the columns that are given back, where not all are wanted; texts then go to the tasks and not back."""
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    kept = [docs.schema[c] for c in (docs.columns if keep is None else keep)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text", 750_000):
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(shared.value.scores(encoded(b.column("text"))))], [*(f.name for f in kept), name])

    return docs.mapInArrow(score, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").filter(~held))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
