"""The operators of mosaiq.llm against SQL or brute force, and on odd rows: nulls in any column, empty and very
long texts, ties and repeated rows, empty tables, and further columns with names that the operators use themselves."""

import base64
import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import common, decontaminate, exact_dedup, language, mixing, ngram_join, queries, secrets, substring_dedup, toxicity, url_filter, warc
from mosaiq.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
SCHEMA = "doc_id long, text string, source string, score double, key long, n long, h long, row long, kept string, size long"


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows; the further columns clash with names inside the operators."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, long.replace(" ", "\n")), (7, "É Ü ß 東京 \U0001f600 naïve"), (7, "É Ü ß 東京 \U0001f600 naïve"), (8, "x" * 50_000), (None, "a"), (None, None),
             (9, "one two three"), (10, "ONE  two\x0bthree"), (11, "one two three four"), (12, "\x00 odd \x1f bytes"), (7, "other text of id seven")]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else f"s{k % 2}", None, k, k, None, 5, "q", None) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(3)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def test_hashing_and_words():
    texts = [b"", b"  a bc\n", b"x" * 3_000_000 + b" y", b"a bc a"]
    data, s, e, first = common.words(texts)
    h = common.span_hashes(data, s, e)
    assert first.tolist() == [0, 0, 2, 4, 7]
    assert h[0] == h[4] == h[6] and h[1] == h[5] and len({*h.tolist()}) == 4
    big = np.arange(100, dtype=np.uint64)
    for n in (1, 2, 3, 7, 25, 50):
        g = common.ngrams(big, n)
        assert len(g) == 101 - n and len(set(g.tolist())) == len(g)
        assert (common.ngrams(np.concatenate([big, big]), n)[:101 - n] == g).all()
    assert len(common.ngrams(big[:3], 7)) == 0


def test_sieve(spark):
    held = spark.range(0, 3000, 3, numPartitions=9).select(F.xxhash64("id").alias("h"))
    got = [r.id for r in spark.range(20_000).filter(common.sieve(held)(F.xxhash64("id"))).collect()]
    assert set(range(0, 3000, 3)) <= set(got) and len(got) <= 1010
    assert spark.range(50).filter(common.sieve(held.limit(0))(F.xxhash64("id"))).count() == 0


def test_url_filter(spark):
    urls = spark.createDataFrame([(1, "https://A.Example.NET/en/x?q", 1), (1, "https://A.Example.NET/en/x?q", 2), (2, None, 1), (3, "net/", 1), (4, "http://net", 1), (5, "http://net/", 1), (6, "x://" + "a." * 5000 + "net/" + "p" * 9000, 1), (7, "http://notnet/", 1), (8, "http://x.org/fr/", 1)],
                                 "page_id long, url string, short int")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge_urls(urls, rules).orderBy("page_id").collect()]
    want = [(1, "a.example.net", "example.net/en/", "allow")] * 2 + [(2, "", None, "allow"), (3, "", None, "allow"), (4, "net", None, "allow"), (5, "net", "net/", "block"), (6, "a." * 5000 + "net", "net/", "block"), (7, "notnet", None, "allow"), (8, "x.org", "org/fr/", "allow")]
    assert got == want
    assert url_filter.judge_urls(urls, rules.limit(0)).filter("verdict = 'allow' AND rule IS NULL").count() == 9
    assert url_filter.judge_urls(urls.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(urls.filter("page_id = 5"), spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block"), (None, "/", "block"), ("net", None, "allow")], "host string, path string, verdict string")).collect()] == ["block"]


def test_url_filter_clashing_columns(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.net/", "h", "p", "r", "v", "d", 1, "s", "k")], "page_id long, url string, host string, path string, rule string, verdict string, digest string, n int, short string, found string")
    out = url_filter.judge_urls(urls, rules)
    assert out.columns == ["page_id", "url", "digest", "n", "short", "found", "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in out.collect()] == [(1, "http://a.net/", "d", 1, "s", "k", "a.net", "/", "net/", "block")]
    assert [r.host for r in url_filter.judge_urls(urls.select("page_id", F.col("url").alias("path")), rules, url="path").collect()] == ["a.net"]


def test_url_filter_brute(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "net", "org", "c-d"])
    rules = {(".".join(label() for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(30)}
    urls = [(k, f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}/{''.join(rng.choice('ab/') for _ in range(rng.randint(0, 5)))}") for k in range(400)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")).collect()}
    for k, u in urls:
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[k].rule, got[k].verdict) == best[2:], u


def test_exact_dedup(spark, odd):
    got = listed(exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept"))
    want = [(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 1, True), (4, 4, 2, True), (None, 4, 2, False), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 2, True), (7, 7, 2, False), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True), (11, 11, 1, True), (12, 12, 1, True)]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_quotient_filters_merge_losslessly(spark):
    rng = random.Random(2)
    keys = [rng.choice([-2**63, -1, 0, 1, 2**63 - 1, rng.getrandbits(63), rng.randint(0, 50)]) for _ in range(3000)]
    fps = spark.createDataFrame([(k,) for k in keys], "fp long").repartition(7)
    count = defaultdict(int)
    for k in keys:
        count[k] += 1
    for rows in (10, 5_000_000):  # one block, and many
        assert {r.fp: r.n for r in exact_dedup.repeated_fingerprints(fps, rows).collect()} == {k: n for k, n in count.items() if n > 1}


@pytest.mark.parametrize("bits", [3, 8, 13, 64])
def test_quotient_filter(bits):
    """Runs, shifted runs, counts of several digits, merging filters of unlike size and what is written of them."""
    rng = random.Random(bits)
    whole, count = exact_dedup.QuotientFilter.of(np.empty(0, np.uint64), np.empty(0, np.uint64), bits), defaultdict(int)
    for size in (1, 40, 3, 300, 0, 7):
        part = defaultdict(int)
        for _ in range(size):
            part[rng.choice([rng.getrandbits(bits), (1 << bits) - 1, rng.randint(0, 7)])] += rng.choice([1, 1, 2, 3, 255, 256, 10**6, 2**40])
        keys = np.array(sorted(part), np.uint64)
        one = exact_dedup.QuotientFilter.of(keys, np.array([part[k] for k in sorted(part)], np.uint64), bits)
        assert 1 <= one.q < bits and one.ends.sum() == one.runs.sum() == len(np.unique(keys >> np.uint64(bits - one.q)))
        one = exact_dedup.QuotientFilter.loads(one.dumps(), bits)
        got = one.entries()
        assert got[0].tolist() == sorted(part) and got[1].tolist() == [part[k] for k in sorted(part)]
        whole = whole.merge(one) if size % 2 else one.merge(whole)
        for k, n in part.items():
            count[k] += n
        got = whole.entries()
        assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == dict(count) and got[0].tolist() == sorted(count)


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_join_brute(spark, size, percent):
    """A chain and a cluster of near copies larger than a small group, exact copies, short texts and unlike texts that share a passage."""
    rng = random.Random(size)
    passage, base, rows = prose(rng, 30), prose(rng, 90).split(), []
    for k in range(60):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append(" ".join(w))
    chain = prose(rng, 120).split()
    for k in range(25):
        chain[4 * k] = f"turn{k}"
        rows.append(" ".join(chain))
    rows += [prose(rng, 40) + " " + passage for _ in range(40)] + ["a", "A", "a b", "b a", "", None, "a b c d e", "a b c d", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, size, percent).collect()}
    assert got == brute_components(rows, size, percent)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_ngram_join_branches_and_blocks(spark, monkeypatch, levels):
    """Without pivots' luck: one pivot, tiny nodes and blocks, and any number of branches must find the same links."""
    rng = random.Random(9)
    base, other = prose(rng, 60).split(), prose(rng, 30).split()
    rows = []
    for k in range(50):
        w = list(base) if k % 3 else base[:30] + other
        for j in range(k % 5):
            w[(7 * k + 11 * j) % 60] = f"n{k}-{j}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_ngram_join_writes_each_steps_pairs(spark, monkeypatch):
    """The steps below open nodes hand over written pairs, not one plan with the shuffles of all steps."""
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = [(k, " ".join(f"n{k}-{j}" if j in [(7 * k + 11 * i) % 60 for i in range(k % 5)] else w for j, w in enumerate(base))) for k in range(50)]
    for name, value in (("PIVOTS", 1), ("BLOCK", 4), ("SMALL", 3), ("LEVELS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    plans, descend = [], ngram_join.Join.descend

    def noted(self, rows):
        out = descend(self, rows)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ngram_join.Join, "descend", noted)
    ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).count()
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)


def test_ngram_join_sends_little_to_the_driver(spark, monkeypatch):
    """Rarity comes to the driver as a byte a bucket, not as counts, and equals what the whole counts give."""
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(40)]
    sent, in_tree = [], ngram_join.in_tree

    def noted(*args, **more):
        rows = in_tree(*args, **more)
        sent.append(sum(len(r[0]) for r in rows))
        return rows

    monkeypatch.setattr(ngram_join, "in_tree", noted)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    n = np.bincount(ngram_join._bucket(ngram_join.shingles([t.encode() for t in texts], 4)[1]), minlength=ngram_join.BUCKETS)
    whole = np.clip(np.round(4 * np.log2((n + 1) / (n.mean() + 1))) + 20, 0, 63)
    assert (ngram_join.rarity(df, 4) == whole).all() and sent == [ngram_join.BUCKETS]


@pytest.mark.parametrize("linked", [False, True])
def test_ngram_join_carries_stars_on(spark, monkeypatch, linked):
    """The first components' stars, not all links again, go into the second; none are made where open nodes give no links."""
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = [(k, " ".join(f"n{k}-{j}" if j in [(7 * k + 11 * i) % 60 for i in range(k % 5)] else w for j, w in enumerate(base))) for k in range(50)]
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    taken, made, links, components = [], [], ngram_join.Join.links, ngram_join.components

    def found(self, pairs):
        out = links(self, pairs)
        if taken and not linked:
            out = out.limit(0)
        taken.append(out.count())
        return out

    def noted(df, stage):
        made.append((df.count(), components(df, stage)))
        return made[-1][1]

    monkeypatch.setattr(ngram_join.Join, "links", found)
    monkeypatch.setattr(ngram_join, "components", noted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert len(taken) == 2 and made[0][0] == taken[0]
    if linked:
        assert got == brute_components(rows, 4, 85)
    if taken[1]:
        assert [n for n, _ in made] == [taken[0], made[0][1].count() + taken[1]]
    else:
        assert len(made) == 1


def test_driver_gives_memory_back(spark, monkeypatch):
    """A stage of the pipeline begins with giving back what the ones before have left in the driver."""
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(corpus_pipeline, "give_back_driver", asked.append)
    docs = spark.createDataFrame([(1, "a b c", "web")], "doc_id long, text string, source string")
    before = {k: spark.conf.get(k) for k in corpus_pipeline.BATCH}
    corpus_pipeline.mixing(spark, docs, "")
    for k, v in before.items():
        spark.conf.set(k, v)
    assert asked == [spark]


def test_ngram_join_hot_ngram(spark):
    """5,000 unlike texts that share one rare passage, near copies among them."""
    rng = random.Random(15)
    texts = []
    for k in range(5000):
        w = [f"u{rng.randrange(10**6)}" for _ in range(30)] if k % 10 else prose(rng, 30, [f"c{j}" for j in range(50)]).split()
        texts.append(w[:12] + "one passage that all share".split() + w[12:])
        if k % 100 == 0:
            texts.append([*texts[-1], "more"])
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()}
    assert got == {k: k - 1 if len(w) == 36 else k for k, w in enumerate(texts)}


def test_ngram_join_odd(spark, odd):
    got = listed(ngram_join.ngram_components(odd, 4, 85).select("doc_id", "n_shingles", "component_id"))
    by = defaultdict(list)
    for i, n, c in got:
        by[i].append((n, c))
    assert len(got) == 16 and by[1] == [(0, 1)] and by[3] == [(0, 3)] and by[4] == [(1, 4)] and by[6][0][1] == 5 and by[10] == [(1, 9)] and by[11] == [(1, 11)]
    assert sorted(by[None], key=str) == [(0, None), (1, 4)] and by[7] == [(1, 7), (1, 7)] + [(2, 7)] or sorted(by[7]) == [(2, 7), (3, 7), (3, 7)]
    assert ngram_join.ngram_components(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(5, 5), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), common.Stage(spark, "test")).collect()}
    assert {k: got.get(k, k) for k in root} == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a long, b long"), common.Stage(spark, "test")).count() == 0


def test_walk_shares_and_prunes():
    rng = random.Random(5)
    own = np.array(sorted(rng.sample(range(1000), 200)), np.uint64)
    sets = []
    for k in range(60):
        s = set(own.tolist()) - set(rng.sample(own.tolist(), rng.randint(0, 40))) | set(rng.sample(range(1000), rng.randint(0, 40)))
        sets.append((k, np.array(sorted(s), np.uint64)))
    sets += [(60, own[:180]), (61, own[:190]), (62, own), (63, own[:0]), (64, own[:100])]
    sets.sort(key=lambda x: x[1].tolist())
    want = sorted(k for k, s in sets if 100 * len(np.intersect1d(s, own)) >= 85 * len(np.union1d(s, own)))
    for stride in (1, 7, 64):
        assert sorted(ngram_join.walk(own, sets, 85, stride)) == want
    assert want and len(want) < len(sets)


def test_toxicity(spark, odd):
    rng = random.Random(6)
    bad = ["grobblehead", "snarfwit"]
    rows, labels = [], []
    for k in range(480):
        w = prose(rng, rng.randint(20, 200)).split()
        toxic = k % 3 == 0
        if toxic:
            for _ in range(1 + len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(1, 0), (2, 1), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    learn = F.col("doc_id") % 4 != 0
    model = toxicity.learn_toxicity(docs, marks.filter(learn))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in range(480) if k % 4 == 0]
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in held) >= 0.9 * len(held)
    unseen = spark.createDataFrame([(1, prose(rng, 30) + " grobblehaed " + prose(rng, 30)), (2, prose(rng, 60)), (3, prose(rng, 3000) + " snarfwit snarfwit " + prose(rng, 3000))], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(unseen, model).collect()}
    assert s[1] > s[2] and s[3] >= 0.5 > s[2]
    scored = toxicity.score_toxicity(odd, model, "toxic").collect()
    assert len(scored) == 16 and all(0 <= r.toxic <= 1 for r in scored) and all(r.toxic == toxicity.BLANK for r in scored if not r.text or not r.text.strip())
    with pytest.raises(ValueError):
        toxicity.score_toxicity(odd, model)
    blank = toxicity.learn_toxicity(docs, marks.filter("toxic = 1"))
    assert {r.score for r in toxicity.score_toxicity(docs.limit(5), blank).collect()} == {toxicity.BLANK}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_reads_long_runs_whole():
    rng = random.Random(61)
    syllables = "ba de fi go ku la me ni po ru sa te vi wo zu".split()
    plain = lambda n: [rng.choice(syllables) + rng.choice(syllables) for _ in range(n)]

    def made(toxic, glue):
        w = plain(rng.randint(20, 60))
        return glue.join(w + ["grobblehead"] if toxic else w).encode()  # the term stands last

    glues = (" ", "", "\u3002", "\u3001", "\xa0", "\u2014", "\u200b", "\uff0c")
    labels = np.array([k % 2 for k in range(640)])
    model = toxicity.train([made(y, glues[k // 2 % len(glues)]) for k, y in enumerate(labels)], labels)
    for glue in glues:
        scores = model.scores([made(k % 2, glue) for k in range(40)])
        assert (scores >= 0.5).tolist() == [k % 2 == 1 for k in range(40)], repr(glue)
    # A model that learned spaced words alone finds the term in a run as well.
    model = toxicity.train([made(y, " ") for y in labels], labels)
    scores = model.scores([made(k % 2, "") for k in range(40)])
    assert scores[1::2].min() > scores[::2].max()


def test_toxicity_learns_many_rare_insults():
    rng = random.Random(62)
    insults = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(9)) for _ in range(100)]
    syllables = "ba de fi go ku la me ni po ru sa te vi wo zu".split()

    def made(toxic, k):
        w = [rng.choice(syllables) + rng.choice(syllables) for _ in range(rng.randint(10, 40))]
        if toxic:
            w[rng.randrange(len(w))] = insults[k % 100]  # each marks 1 % of the toxic texts
        return " ".join(w).encode()

    labels = np.repeat([0, 1], 1500)
    model = toxicity.train([made(y, k) for k, y in enumerate(labels)], labels)
    assert (model.scores([made(1, k) for k in range(100)]) >= 0.5).mean() >= 0.95
    assert (model.scores([made(0, k) for k in range(400)]) >= 0.5).mean() <= 0.02


def test_toxicity_words_and_pieces():
    split = lambda t: [bytes(d[a:z]).decode() for d, s, e, _ in [toxicity.split_words([t.encode()])] for a, z in zip(s, e, strict=True)]
    assert split("caf\xe9\u3001\u6771\u4eac\u3002a\xa0b\u2014c\u200bd\uff0ce \U0001f600x") == ["caf\xe9", "\u6771\u4eac", "a", "b", "c", "d", "e", "\U0001f600x"]
    for broken in (b"\xe3\x80", b"\xff\xff", b"\xc3(", b"a\xf4\xbf\xbf\xbf"):
        assert len(toxicity.split_words([broken, b"x"])[1]) >= 2
    for n in (1, 12, 39, 40, 41, 44, 45, 52, 53, 1000):
        s, e, lacks, first = toxicity.pieces(np.array([0, 3]), np.array([2, 3 + n]), np.array([0, 1, 2]))
        grams = {k for a, z in zip(s[1:], e[1:], strict=True) for k in range(a - 3, z - 3 - max(toxicity.GRAMS) + 1)}
        assert grams == set(range(n - max(toxicity.GRAMS) + 1)) and first.tolist() == [0, 1, len(s)] and e[-1] == 3 + n
        assert (n > 40) == (len(s) > 2) and (e - s).max() <= 40 and not lacks[1] & 1 and not lacks[-1] & 2 and (n <= 40 or all(lacks[1:]))


def test_decontaminate_odd(spark, odd):
    benchmark = spark.createDataFrame([(1, "One two, three", 1), (2, None, 1), (None, "a", 1), (3, "...", 1), (4, "É ü", 1), (5, " ".join(f"w{k}" for k in range(12)), 1), (6, "one two three", 1)], "item_id long, text string, token int")
    got = listed(decontaminate.decontaminate(odd, benchmark).select("doc_id", "n_words", "n_hit", "items"))
    by = defaultdict(list)
    for i, n, hit, items in got:
        by[i].append((n, hit, items))
    assert len(got) == 16
    assert by[9] == by[10] == [(3, 3, ["1", "6"])] and by[11] == [(4, 3, ["1", "6"])] and by[1] == by[2] == by[3] == [(0, 0, [])] and by[8] == [(1, 0, [])]
    assert sorted(by[7]) == [(5, 0, []), (5, 0, []), (5, 0, [])] or [x[1] for x in sorted(by[7])].count(0) == 3
    assert decontaminate.decontaminate(odd.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminate(odd, benchmark.limit(0)).filter("contaminated").count() == 0


def test_decontaminate_brute(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(25)]
    items = [(k, prose(rng, rng.randint(1, 16), vocabulary)) for k in range(25)]
    docs = [(k, prose(rng, 60, vocabulary) + " " + rng.choice(items)[1] + " " + prose(rng, 5, vocabulary)) for k in range(60)]
    want = {}
    for i, t in docs:
        w, hit, found = t.split(), set(), set()
        for item, u in items:
            x = u.split()
            n = min(10, len(x))
            for win in ([x[k:k + n] for k in range(len(x) - n + 1)]):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == win:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        want[i] = (len(w), len(hit), sorted(found))
    for part in (decontaminate.PART, 20):  # one broadcast, and several
        monkeypatch.setattr(decontaminate, "PART", part)
        out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out.collect()} == want


def test_decontaminate_items_without_id(spark, tmp_path):
    rng = random.Random(71)
    passages = [prose(rng, n) for n in (14, 12, 11, 3)]
    items = [(1, passages[0]), (None, passages[1]), (None, passages[2]), (2, passages[2]), (None, passages[3]), (None, None)]
    docs = [(k, prose(rng, 9, WORDS) + " " + " ".join(p) + " " + prose(rng, 9, WORDS)) for k, p in enumerate([[], passages[:1], passages[1:2], passages[2:3], passages[:3], passages[3:], passages])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op5_decontaminate"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(0, 0, ""), (14, 1, "1"), (12, 1, ""), (11, 2, "2"), (37, 3, "1,2"), (3, 1, ""), (40, 3, "1,2")]
    assert {k: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items()} == {k: (n, m, sha(t), n > 0) for k, (n, m, t) in enumerate(want)}
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.values()) == sorted(con.execute(queries.ORACLES["op5_decontaminate"]).fetchall())


def test_warc(spark):
    pages = [(1, "http://a.b/x", "hé"), (2, "http://a.b/x", "hé"), (3, None, None), (None, "http://a.b/x y\r\n", "hé"), (5, "zz", ""), (5, "zz", ""), (6, "http://c.a.b/", "z" * 300_000)]
    df = spark.createDataFrame([(*p, "q", 1) for p in pages], "page_id long, url string, html string, key string, at int").repartition(3)
    stage = common.Stage(spark, "warc")
    captures = warc.write_archive(df, f"{stage.root}/a", stage)
    parts = warc.build_index(captures, f"{stage.root}/i", stage)
    got = listed(warc.read_records(warc.find_captures(df, parts), True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    row = lambda i, t, to: (i, len(t.encode()), digest(t), "response" if to is None else "revisit", to, bytearray(t.encode()) if to is None else None)
    want = [row(1, "hé", 2), row(2, "hé", None), row(3, "", 5), row(None, "hé", 2), row(5, "", None), row(5, "", None), row(6, "z" * 300_000, None)]
    assert got == sorted(want, key=str)
    assert warc.find_captures(spark.createDataFrame([(9, "http://a.b/x"), (1, "http://nowhere/")], "page_id long, url string"), parts).count() == 0
    none = warc.write_archive(df.limit(0), f"{stage.root}/b", stage)
    assert warc.read_records(warc.find_captures(df, warc.build_index(none, f"{stage.root}/j", stage))).count() == 0
    large = warc.write_archive(df, f"{stage.root}/c", stage, least=1)
    assert {r.page_id: r.record_type for r in warc.read_records(warc.find_captures(df, warc.build_index(large, f"{stage.root}/k", stage))).collect()}[3] == "response"


def test_warc_index_of_many(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    monkeypatch.setattr(warc, "PER_PART", 20)
    stage = common.Stage(spark, "warc")
    pages = spark.range(100).selectExpr("id AS page_id", "concat('http://h', id % 7, '.org/', id % 3) AS url", "concat('p', id % 50) AS html")
    captures = warc.write_archive(pages, f"{stage.root}/a", stage)
    parts = warc.build_index(captures, f"{stage.root}/i", stage)
    assert len(parts) > 1
    got = warc.read_records(warc.find_captures(pages, parts)).collect()
    assert sorted(r.page_id for r in got) == list(range(100))
    assert all((r.record_type == "response") == (r.page_id >= 50) and r.refers_to == (None if r.page_id >= 50 else r.page_id + 50) for r in got)


def test_language(spark, odd):
    rng = random.Random(8)
    spell = {"xx": "ba be bi bo".split(), "yy": "zu zy zo za".split(), "zz": "ñe ña ñi ño".split()}
    text = lambda lang: " ".join("".join(rng.choice(spell[lang]) for _ in range(3)) for _ in range(40))
    rows = [(k, text(lang), lang) for k, lang in enumerate(list(spell) * 30)] + [(None, "ba", "xx"), (900, None, "xx"), (901, "ba", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(docs.filter("doc_id % 2 = 0"))
    assert model.languages == ["xx", "yy", "zz"]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:90]) and got[900] == "und"
    out = language.identify(odd, model).collect()
    assert len(out) == 16 and sum(r.lang_pred == "und" for r in out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.learn_languages(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs.limit(3), nothing).collect()} == {"und"}


def test_language_of_seventy(spark):
    rng = random.Random(81)
    names = [f"l{k:02}" for k in range(70)]
    text = lambda k: " ".join("".join(chr(0x4E00 + 6 * k + rng.randrange(6)) for _ in range(5)) for _ in range(20 + k))
    docs = spark.createDataFrame([(100 * k + j, text(k), name) for k, name in enumerate(names) for j in range(4)], "doc_id long, text string, lang string")
    model = language.learn_languages(docs.filter("doc_id % 2 = 0"))
    assert model.languages == names
    got, score = model.judge([text(k) for k in range(70)])
    assert got == names and score.min() > 0.5
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {r.doc_id: r.lang for r in docs.collect()}


def test_decontaminate_lists_shared_by_many_items(spark):
    """A line of very many items costs its list once a document; windows are cut into parts by bytes too."""
    line = "this line stands in every single item of the set"
    items = [(k, line) for k in range(400)] + [(None, line), (1000, "w1 w2"), (1001, "x" * 300)]
    docs = spark.createDataFrame([(1, f"{line} and " * 60 + "w1 w2"), (2, "w1 w2 " * 50), (3, "nothing"), (None, line), (4, "x" * 300)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {1: ({*map(str, range(400)), "1000", None}, 602), 2: ({"1000"}, 100), 3: (set(), 0), None: ({*map(str, range(400)), None}, 10), 4: ({"1001"}, 1)}
    for most in (decontaminate.PART_BYTES, 100):
        old, decontaminate.PART_BYTES = decontaminate.PART_BYTES, most
        try:
            got = {r.doc_id: ({*r["items"]}, r.n_hit) for r in decontaminate.decontaminate(docs, benchmark).collect()}
        finally:
            decontaminate.PART_BYTES = old
        assert got == want


def test_mixing(spark, odd):
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.choice([1, 40, 300])), None if k % 5 == 4 else f"s{k % 5 if k % 10 else 0}") for k in range(150)] + [(1000, None, "empty"), (1001, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.taken_words(mixing.mix_sources(docs, block=16)).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.remove(s)
    taken = defaultdict(int)
    for i, _, s in rows:
        r = got[i]
        assert r.size == size[i] and r.source_size == total[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 32 for s in names)
    again = {r.doc_id: r.taken for r in mixing.taken_words(mixing.mix_sources(docs.repartition(5), block=16)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    out = mixing.taken_words(mixing.mix_sources(odd)).collect()
    assert len(out) == 16 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.taken_words(mixing.mix_sources(docs.limit(0))).count() == 0


def test_mixing_draws(spark):
    """Shards' counts carry the result: they fill each shard, sum up to each source's slots, vary, and taken follows them."""
    docs = spark.createDataFrame([(k, " ".join(["w"] * 40), "abc"[min(k % 8, 2)]) for k in range(800)], "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, block=16, shard=64)
    draws = mix.draws.collect()
    slots = {r.sid: r.slots for r in mix.sources.collect()}
    total, by_shard, by_source = sum(slots.values()), defaultdict(int), defaultdict(list)
    for r in sorted(draws):
        assert r.place == by_shard[r.shard] and r.start == sum(n for n in by_source[r.sid])
        by_shard[r.shard] += r.n
        by_source[r.sid].append(r.n)
    assert all(n == min(64, total - 64 * k) for k, n in by_shard.items()) and len(by_shard) == -(-total // 64)
    assert {k: sum(v) for k, v in by_source.items()} == slots
    share = slots[0] / total
    spread = np.array(by_source[0][:-1]) - 64 * share
    assert 0.5 < spread.var() / (64 * share * (1 - share)) < 1.6 and abs(spread).max() > 0  # as a multinomial's
    assert "shard" in executed(mixing.taken_words(mix))
    got = mix.slots().collect()
    assert sorted(r.slot for r in got) == list(range(total)) and all(r.slot // 64 == r.shard for r in got)
    for sid, n in slots.items():
        assert sorted(r.i for r in got if r.sid == sid) == list(range(n))
    uses = defaultdict(int)
    for r in got:
        uses[r.sid, r.block] += 1
    want = defaultdict(int)
    for r in mix.docs.collect():
        for p in range(r.start, r.start + r.size):
            want[r.doc_id] += uses[r.sid, p // 16]
    assert {r.doc_id: r.taken for r in mixing.taken_words(mix).collect()} == want
    fewer = mixing.Mix(mix.docs, mix.sources, mix.draws.filter("shard <> 0"), 16, 64, 11)
    assert sum(r.taken for r in mixing.taken_words(fewer).collect()) == sum(want.values()) - 64 * 16


def test_targets_of_many_sources(spark):
    rng = random.Random(12)
    sizes = {f"s{k:03}": rng.choice([0, 1, 7, 100, 5000]) for k in range(200)} | {None: 3}
    names = sorted(s for s in sizes if s) + [None]
    stage = common.Stage(spark, "test")
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5), (5, 2, 1), 3.0, stage).collect()
    assert [r.source for r in sorted(got)] == names and [r.sid for r in sorted(got)] == list(range(201))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), float(sum(sizes.values())), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    assert {r.source: r.target for r in got} == pytest.approx(target)


def test_mixed_blocks_hold_the_documents_words(spark):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(3 * k)), "s") for k in range(40)] + [(None, "n1 n2 n3", "s"), (None, "m1 m2", "s"), (7, "other words", "s"), (7, "other words", "s"), (41, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, block=10)
    blocks = mixing.mixed_blocks(docs, mix).collect()
    words = [w for _, t, _ in rows for w in (t or "").split()]
    assert sorted(r.slot for r in blocks) == list(range(-(-len(words) // 10))) and sorted(w for r in blocks for w in r.text.split()) == sorted(words)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutation(spark, n):
    got = [r.v for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("v")).collect()]
    assert sorted(got) == list(range(n))


def brute_substrings(rows, size):
    first = {}
    for i, t in rows:
        w = (t or "").split(" ")
        for k in range(len(w) - size + 1):
            win = tuple(w[k:k + size])
            first[win] = min(first.get(win, i), i)
    out = {}
    for i, t in rows:
        w = [x for x in (t or "").split(" ") if x]
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k:k + size])] < i for p in range(k, k + size)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [50, 7, 2, 110])
def test_substring_dedup_brute(spark, size):
    rng = random.Random(size)
    pool = [prose(rng, rng.randint(size // 2, 2 * size)) for _ in range(6)]
    rows = [(k, " ".join(rng.choice([prose(rng, rng.randint(1, size)), rng.choice(pool), "dup " * rng.randint(1, size)]).strip() for _ in range(6))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, None), (201, ""), (202, "short")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size).collect()}
    assert got == brute_substrings(rows, size)


def test_substring_levels():
    assert substring_dedup.lengths(50) == [13, 25] and substring_dedup.lengths(200) == [13, 25, 50, 100] and substring_dedup.lengths(7) == [4] and substring_dedup.lengths(50, 3) == [4, 7, 13, 25]


def test_substring_dedup_odd(spark, odd):
    got = listed(substring_dedup.substring_dedup(odd, texts=True).select("doc_id", "n_words", "n_removed"))
    assert len(got) == 16 and (5, 30_000, 0) in got and (6, 30_000, 30_000) in got and (None, 1, 0) in got
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("same_id", [None, 900])
def test_substring_dedup_many_texts_of_one_id(spark, same_id):
    """2,000 texts under one id: each loses its own words."""
    rng = random.Random(101)
    passages = [(k, prose(rng, 12)) for k in range(20)]
    texts = []
    for _ in range(2000):
        a, z = prose(rng, rng.randint(0, 40)).split(), prose(rng, rng.randint(1, 40)).split()
        texts.append(" ".join([*a, rng.choice(passages)[1], *z]))
    assert len(set(texts)) == 2000
    docs = spark.createDataFrame(passages + [(same_id, t) for t in texts], "doc_id long, text string").repartition(4)
    seen = {tuple(t.split()[k:k + 10]) for _, t in passages for k in range(3)}
    want = []
    for t in texts:
        w = t.split()
        gone = {p for k in range(len(w) - 9) if tuple(w[k:k + 10]) in seen for p in range(k, k + 10)}
        want.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    got = substring_dedup.substring_dedup(docs, 10).filter(F.col("doc_id").eqNullSafe(same_id)).select("n_words", "n_removed", "kept_sha256")
    assert listed(got) == sorted(want, key=str)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def shuffled_bytes(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_stage_frees_shuffles_of_written_tables(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(common.FREE, None)
    kept = common.Stage(spark, "freed", free=True).keep(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).count(), compression="zstd")
    assert shuffle_files(spark) <= before and spark.conf.get(common.FREE, None) == set_to
    assert kept.count() == 5_000 and kept.agg(F.sum("count")).first()[0] == 20_000


def test_substring_dedup_does_not_shuffle_the_lists_of_documents_without_copies(spark):
    """Few documents have copies; no join is broadcast, as on large tables."""
    rng = random.Random(31)
    rows = [(k, " ".join(f"{rng.getrandbits(40):x}" for _ in range(400))) for k in range(1500)]
    rows += [(2000 + k, rows[k][1]) for k in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    set_to = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = listed(substring_dedup.substring_dedup(docs).select("doc_id", "n_removed"))
        moved = (shuffled_bytes(spark) - before) / len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", set_to)
    assert got == sorted([(k, 0) for k in range(1500)] + [(2000 + k, 400) for k in range(15)], key=str)
    assert moved < 850  # bytes a document: 766; with every list through the join with copies 946


def test_secrets_brute(spark):
    rng = random.Random(11)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api__key", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "\n", "é", "日本", "%", "x-1/2+3_.=", "ghp_", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----"]
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([7, 8, 31, 32, 33, 64])))
    caps = lambda: "".join(rng.choice("ABCXYZ0189") for _ in range(rng.choice([11, 12, 13])))
    rows = [(k, "".join(rng.choice([rng.choice(bits), hexes(), caps(), "token=", 'secret: "']) for _ in range(rng.randint(0, 12)))) for k in range(3000)] + [(4000, None), (4001, "y" * 100_000 + "a" * 32), (4002, "f" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans) for r in secrets.scan_secrets(docs).collect()}
    some = 0
    for i, t in rows:
        want = sorted(secrets.exact_spans(t or "", list(secrets.RULES)))
        assert got[i] == want, t
        some += bool(want)
    assert 500 < some < 3000


def test_secrets_odd(spark, odd):
    out = secrets.scan_secrets(odd).collect()
    assert len(out) == 16 and not any(r.spans for r in out)
    assert secrets.scan_secrets(odd.limit(0)).count() == 0


def test_automaton_is_minimal_and_complete():
    scanner = secrets.Scanner.of(secrets.RULES)
    for a in (scanner.combined, *scanner.matches, *scanner.kept):
        assert a.masks[0] == 0 and a.step.max() == len(a.step) - 1
        assert len(np.unique(np.column_stack([a.masks, a.step]), axis=0)) == len(a.step)
    assert scanner.combined.resets[ord("\n")] and not scanner.combined.resets[ord("a")]


def test_regexes_are_compiled_themselves():
    """Automata of regexes against the regex engine: all places at which a match ends, and spans."""
    rng = random.Random(13)
    for regex, chars in [("a(?:b|cd)+e?", "abcde"), ("[a-c]{2}x{1,3}", "abcx"), ("(?ai:ab|ba)[-+.]", "aAbB-+."), (r"\x41\x20*[:=]", "A :="), ("-*a--", "-a"), ("ab{2,}", "ab")]:
        one = secrets.compile_trees([secrets.parse(regex)], anchored=True)
        free = secrets.compile_trees([secrets.parse(regex)])
        for _ in range(300):
            t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 14)))
            ends = {e for s in range(len(t)) for e in range(s, len(t) + 1) if re.fullmatch(regex, t[s:e])}
            assert (secrets.hits(np.frombuffer(t.encode(), np.uint8), free, piece=3)[0] + 1).tolist() == sorted(ends), (regex, t)
            longest = max((e for e in range(len(t) + 1) if re.fullmatch(regex, t[:e])), default=-1)
            assert one.end(t.encode(), 0, len(t)) == longest, (regex, t)
    for wrong in ("a.b", "[^a]", "(a", "a)", r"\d", "*a", "(?=a)"):
        with pytest.raises(ValueError):
            secrets.parse(wrong)
    with pytest.raises(ValueError):
        secrets.at_least(secrets.parse("a+b+"), 0, 5)
    with pytest.raises(ValueError):
        secrets.Scanner.of((secrets.Rule("all", "a*", 0, 0),))


def test_secrets_consume_short_matches_and_unbroken_texts():
    import time

    rng = random.Random(14)
    rules = list(secrets.RULES)
    scan = secrets._scan(secrets.RULES)

    def spans(texts):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        return [[(s["start"], s["end"], s["kind"]) for s in row.as_py()] for b in scan(iter([batch])) for row in b.column("spans")]

    texts = ["token:secret:abcdefgh", "token=token=abcdefgh", "secret:password:abcdefgh1", "token" + " " * 3000 + "=" + " " * 3000 + "abcdefgh", "-----BEGIN " + "A " * 4000 + "PRIVATE KEY-----", "f" * 31 + "g" + "f" * 32,
             "x" * 511 + "AKIA" + "0" * 12, "ghp_" + "a" * 1030, "\u00e9" * 600 + " token=abcdefgh"]
    assert spans(texts) == [secrets.exact_spans(t, rules) for t in texts] and sum(map(len, spans(texts))) >= 8
    words = [rng.choice(["plain", "words", "stand", "here", "token"]) for _ in range(400_000)]
    times = []
    for glue in (", ", "_"):
        text = glue.join(words)
        began = time.process_time()
        assert spans([text]) == [secrets.exact_spans(text, rules)]
        times.append(time.process_time() - began)
    assert times[1] <= 3 * times[0] + 1
    # States that last for megabytes, alone and one after the other.
    prose_ = ", ".join(words)
    for text in ("password" + " " * len(prose_), "password" + " " * (len(prose_) // 2) + "= abcdefgh " + "token=" + "aZ9+" * (len(prose_) // 8), "f" * len(prose_)):
        began = time.process_time()
        found = spans([text])
        assert time.process_time() - began <= 3 * times[0] + 2
        assert found == [secrets.exact_spans(text, rules)]


def test_scan_of_lasting_states_at_random():
    """Small pieces, so that states pass through many of them: the same places as one run from left to right."""
    rng = random.Random(12)
    automaton = secrets.Scanner.of(secrets.RULES).combined
    for _ in range(60):
        text = "".join(rng.choice(["password", " " * rng.randint(1, 40), "=", "token", "a" * rng.randint(1, 30), "0" * rng.randint(1, 50), "AKIA", "-----BEGIN ", "é", "\n"]) for _ in range(rng.randint(1, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        state, want = 0, []
        for k, byte in enumerate(data.tolist()):
            state = int(automaton.step.reshape(-1)[state << 8 | byte])
            if automaton.masks[state]:
                want.append((k, int(automaton.masks[state])))
        for piece in (1, 2, 5, 16):
            where, what = secrets.hits(data, automaton, piece)
            assert list(zip(where.tolist(), what.tolist(), strict=True)) == want


def test_queries_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_ngram_join"](spark, sf).collect()}
    assert got == brute_components(rows, 4, 85)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.QUERIES["op10_secret_scan"](spark, sf).collect()}
    assert got == {i: secrets.brute(t) for i, t in rows}
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in queries.QUERIES["op6_warc"](spark, sf).collect()}
    assert got == {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, h in zip(pages.page_id, pages.html, strict=True)}


def larger(sf, size="sf0.01"):
    """The tables of a larger size, where they are: the smallest ones hold too few labels."""
    other = f"{sf.rstrip('/').rpartition('/')[0]}/{size}"
    return other if os.path.isdir(other) else sf


def test_language_query_on_held_out_documents(spark, sf):
    """Held-out accuracy, and popcounts of Bloom slots against a plain vote of n-gram sets."""
    sf = larger(sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    out = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, sf).collect()}
    assert len(out) == len(docs) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    held = [(out[i].lang_pred, lang) for i, lang in zip(docs.doc_id, docs.lang, strict=True) if out[i].held_out and lang is not None]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    count = {lang: Counter() for lang in docs.lang.dropna().unique()}
    for i, lang, t in zip(docs.doc_id, docs.lang, docs.text, strict=True):
        if lang is not None and t is not None and not out[i].held_out:
            count[lang].update(language.gram_hashes([t])[0].tolist())
    top = {lang: dict(sorted(((g, n) for g, n in c.items() if n >= 5), key=lambda x: (-x[1], np.uint64(x[0]).view(np.int64)))[:20_000]) for lang, c in count.items()}
    rate = {lang: {g: n / sum(t.values()) for g, n in t.items()} for lang, t in top.items()}
    best = {}
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best.get(g, 0), x)
    sets = {lang: {g for g, x in r.items() if x >= 0.25 * best[g]} for lang, r in rate.items()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        grams, _, has = language.gram_hashes([t])
        votes = sorted(((sum(g in own for g in grams.tolist()), lang) for lang, own in sets.items()), reverse=True)
        if not has[0]:
            assert out[i].lang_pred == "und" and out[i].score == 0
        elif votes[0][0] - votes[1][0] > 2 + 0.01 * len(grams):
            assert out[i].lang_pred == votes[0][1]


def test_toxicity_query_on_held_out_documents(spark, sf):
    sf = larger(sf, "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet").toPandas() for n in ("documents", "labels"))
    out = {r.doc_id: r for r in queries.QUERIES["op4_toxicity"](spark, sf).collect()}
    assert len(out) == len(docs) and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(out[i].predicted, y) for i, y in zip(labels.doc_id, labels.toxic, strict=True) if i in out and out[i].held_out]
    toxic, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))
    print("held out: found", sum(toxic), "of", len(toxic), "toxic; rejected", sum(clean), "of", len(clean), "clean")
    again = {r.doc_id: r.score for r in queries.QUERIES["op4_toxicity"](spark, sf).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_toxicity_sample_is_bounded_and_fixed(spark):
    """Repeated labelled ids give one text, the same one in each run; bytes bound the sample without cutting texts."""
    rows = [(k, f"{'grobblehead ' if k % 2 else ''}plain text {k % 7} of some words " * 3) for k in range(60)] + [(1, "another text of id one"), (1, "grobblehead three"), (2, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    a, b = toxicity.learn_toxicity(docs, labels), toxicity.learn_toxicity(docs.repartition(7, "text"), labels)
    assert (a.weights == b.weights).all() and a.bias == b.bias and not a.blank
    assert not toxicity.learn_toxicity(docs, labels, most_bytes=2000).blank


def test_toxicity_passes_over_texts_that_do_not_fit(spark):
    """One very long labelled text, whichever comes first by hash, costs its own place alone; a class of long texts alone is read in stretches."""
    rng = random.Random(8)
    rows = [(k, prose(rng, 30) + (" grobblehead" if k % 2 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    for long in (0, 1, 2, 3, 50, 51):
        docs = spark.createDataFrame([(k, t if k != long else t * 3000) for k, t in rows], "doc_id long, text string")
        model = toxicity.learn_toxicity(docs, labels, most_bytes=50_000)
        score = model.scores([b"w1 w2 w3 w4 w5 w6", b"w1 w2 grobblehead w4 w5"])
        assert not model.blank and score[0] < 0.5 < score[1]
    docs = spark.createDataFrame([(k, t if k % 2 == 0 else t * 1000) for k, t in rows], "doc_id long, text string")
    model = toxicity.learn_toxicity(docs, labels, most_bytes=60_000)
    assert not model.blank and model.scores([b"w1 w2 w3 w4 w5 w6"])[0] < model.scores([b"w1 w2 grobblehead w4 w5"])[0]


def test_toxicity_scores_against_plain_python(spark):
    """Scores of the query's own model by its definition, one text at a time: words and pieces, windows, means of subword vectors, softmax, calibration."""
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(1, 40)) + (" grobblehead you fool" if k % 3 == 0 else "")) for k in range(150)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    texts = ["", "  ", "grobblehead", "fine words here", "x" * 90, "東京は晴れ", None] + [t for _, t in rows[:40]] + ["w1 w2 " * 300 + "you fool grobblehead " + "w3 w4 " * 300]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k] - plain_toxicity(model, t)) < 1e-9, t


def plain_toxicity(model, text):
    """The score of one text by definition; hashes alone are the library's."""
    one = lambda x: np.array([x], np.uint64)
    in_word = lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789" if ord(c) < 128 else unicodedata.category(c)[0] not in "ZP" and unicodedata.category(c) not in ("Cc", "Cf")
    runs = "".join(c if in_word(c) else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()
    parts = []
    for run in (r.encode() for r in runs):
        step = toxicity.PIECE - max(toxicity.GRAMS) + 1
        n = -(-(len(run) - toxicity.PIECE) // step) + 1 if len(run) > toxicity.RUN else 1
        parts += [(run[k * step:] if k == n - 1 else run[k * step:k * step + toxicity.PIECE], (k > 0) + 2 * (k < n - 1)) for k in range(n)]
    values = []
    for part, lacks in parts:
        h = common.span_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
        hashes = [common.mix(h + np.uint64(lacks)) if lacks else h]
        marked = [1] * (not lacks & 1) + list(part) + [2] * (not lacks & 2)
        for size in toxicity.GRAMS:
            for at in range(len(marked) - size + 1):
                level = common.mix(one(marked[at] + 99))
                for b in marked[at + 1:at + size]:
                    level = common.pair(level, common.mix(one(b + 99)))
                hashes.append(level)
        values.append(np.mean([model.weights[int(x[0]) % toxicity.BUCKETS] for x in hashes]))
    if not values:
        return toxicity.BLANK
    n, wide, step = len(values), toxicity.WINDOW, toxicity.STEP
    ends = sorted({min(n, k + wide) for k in range(0, max(1, n - wide + step), step)})
    logit = max(np.mean(values[max(0, e - wide):e]) for e in ends) + model.bias
    return 1 / (1 + np.exp(-(model.scale * logit + model.shift)))


def test_languages_with_few_texts_are_learned(spark):
    rng = random.Random(4)
    word = {"en": "the quick brown fox over lazy dogs and then some".split(), "de": "der schnelle braune fuchs über faule hunde und dann".split()}
    rows = [(k, prose(rng, 40, word[lang]), lang) for k, lang in enumerate(["en", "de"] * 60)] + [(900, "zvqo kwyx jjuk", "xx"), (901, "kwyx zvqo", "xx"), (902, "the", "yy"), (903, "123 456", "zz")]
    model = language.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "xx", "yy"]
    assert model.judge(["zvqo kwyx jjuk", "kwyx", "the lazy fox and some dogs", "der faule fuchs", "the quick dogs"])[0] == ["xx", "xx", "en", "de", "en"]


def test_pipeline(spark, sf, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= before
        if name == "near_dedup":
            left = brute_components([(r.doc_id, r.text) for r in rows], 5, 80)
            assert len({c for _, c in left.values()}) == len(rows)
        before, docs = len(rows), out if name == "mixing" else spark.createDataFrame(rows, docs.schema)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd, sf).collect()
        assert len(out) == {"exact_dedup": 11, "near_dedup": 12}.get(name, 16), name
        assert step(spark, odd.limit(0), sf).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf):
    """Each stage on its own input, the documents, by a plain version of what it must keep."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {name: {r.doc_id: r for r in step(spark, docs, sf).collect()} for name, step in corpus_pipeline.STAGES}
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    short = [(i, t) for i, t in rows if len(t or "") < 1500]  # the plain version is slow
    assert len(short) > 80
    for i, t in short:
        assert (i in kept["toxicity"]) == (plain_toxicity(model, t) < 0.5)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert sorted(kept["exact_dedup"]) == sorted(first.values())
    component = {i: c for i, (_, c) in brute_components(rows, 5, 80).items()}
    assert sorted(kept["near_dedup"]) == sorted({*component.values()})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    wanted = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        if w:
            wanted[min(10, len(w))] |= runs(w, min(10, len(w)))
    clean = [i for i, t in rows if not any(runs(words(t), n) & windows for n, windows in wanted.items())]
    assert sorted(kept["decontaminate"]) == sorted(clean) and len(clean) < len(rows)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    assert {i: r["size"] for i, r in kept["mixing"].items()} == sizes and all(0 <= r.taken <= 3 * r["size"] for r in kept["mixing"].values())
    by = defaultdict(list)
    for r in kept["mixing"].values():
        by[r.target, r.source_size].append(r)
    assert all(abs(sum(r.taken for r in rs) - target) <= max(256, 0.02 * target) for (target, _), rs in by.items() if len(rs) == sum(1 for r in kept["mixing"].values() if r.target == target))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark, sf):
    """The plans that decontamination and mixing run, their intermediate tables included."""
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    mix = mixing.mix_sources(docs)
    windows = decontaminate.windows_of(benchmark, 10)
    counts = decontaminate.word_counts(docs, windows.select(F.explode("window").alias("word")).distinct())
    ready = decontaminate.prefix_tokens(windows, counts)
    for df in (decontaminate.decontaminate(docs, benchmark), ready, decontaminate.find_windows(docs, ready), mix.slots(), mix.draws, mix.docs, mix.sources, mixing.taken_words(mix), mixing.mixed_blocks(docs, mix)):
        assert not re.search("Python|Pandas|Arrow", executed(df))


def test_scans_read_needed_columns_alone(spark, sf):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    plan = url_filter.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), rules).select("page_id", "verdict")
    assert "html" not in executed(plan)
    plan = executed(decontaminate.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert "lang" not in plan and "n_chars" not in plan


def test_pipeline_sends_small_batches(spark):
    import corpus_pipeline
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    try:
        corpus_pipeline._small_batches(spark)
        got = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()]
    finally:
        for k in corpus_pipeline.BATCH:
            spark.conf.unset(k)
    assert sum(got) == 5000 and max(got) <= 1000
