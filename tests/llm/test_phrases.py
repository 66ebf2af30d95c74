"""Collocations against plain counting, tries cut and merged in many ranges, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from mosaiq.llm import phrases
from mosaiq.llm.common import Stage

SCHEMA = "doc_id long, text string, lang string, n long, a long, phrase string, rank int"
TEXTS = [None, "", " \t ", ".,;", "a", "A a. a", "x" * 100_000, "É é é ü", "東京 は 東京 は", "one\x0btwo\x1cthree"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows, depth):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, depth + 1):
                for i in range(len(ws) - m + 1):
                    f[lang or "und"][tuple(ws[i:i + m])] += 1
    return f, n


def brute(rows, depth=3, least=10, top=2000, share=50):
    f, n = counted(rows, depth)
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        rows = []
        for p, a in cands.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):  # noqa: E741
            out.append((lang, k + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def some_rows(rng, n):
    words = ["the", "of", "new", "york", "city", "Éa", "b", "zz", "a"] + [f"w{k}" for k in range(30)]
    text = lambda: "".join(rng.choice(words[:9] if rng.random() < 0.7 else words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
    rows = [(text(), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)] + [("new york city " * 400, "en"), ("The the the " * 300, "de")]
    return rows + [(t, "en") for t in TEXTS] + [("same words here again", "fr")] * 12


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(k, t, lang, 1, 2, "x", 3) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_collocations_equal_brute_force(spark, depth):
    rows = some_rows(random.Random(depth), 150)
    assert result(phrases.collocations(frame(spark, rows), depth=depth)) == brute(rows, depth)
    assert result(phrases.collocations(frame(spark, rows), depth=depth, least=4, top=15, share=80)) == brute(rows, depth, 4, 15, 80)


@pytest.mark.parametrize("fan", [3, 1000])
def test_counts_in_many_ranges(spark, fan):
    """Ranges of a few hundred bytes, so that frequent words and pairs are split over several; one pass of cuts, and many."""
    rows = some_rows(random.Random(7), 60)
    stage = Stage(spark, "test")
    got, words = phrases.phrase_counts(frame(spark, rows), stage, 3, 1, flush=2000, room=600, fan=fan)
    f, n = counted(rows, 3)
    f = {(lang, " ".join(p)): (len(p), a, [(f[lang][p[:k]], " ".join(p[k:])) for k in range(1, len(p))]) for lang, c in f.items() for p, a in c.items()}
    held = got.collect()
    assert {(r.lang, r.phrase): (r.size, r.a, [tuple(x) for x in r.links]) for r in held} == f and len(held) == len(f)
    assert {r.lang: r.n for r in words.collect()} == {lang: k for lang, k in n.items() if k}


def test_a_trie_in_parts():
    rng = random.Random(3)
    text = " ".join(rng.choice("a ab b ba c".split()) + rng.choice(["", "", "."]) for _ in range(300)).encode()
    trie = phrases.count_phrases([text], 3)
    everything = {tuple(trie.phrase(d, k + sum(len(x) for x in trie.ids[:d]))): int(c) for d, counts in enumerate(trie.counts) for k, c in enumerate(counts)}
    bounds = sorted(rng.sample(sorted(everything), 9)) + [("zz", "a")]
    seen = {}
    for k, part in trie.cut([[w.encode() for w in b] for b in bounds]):
        part = phrases.Trie.loads(part.dumps())
        lo, hi = bounds[k - 1] if k else (), bounds[k] if k < len(bounds) else ("~",)
        for d, counts in enumerate(part.counts):
            for at, c in enumerate(counts):
                p = tuple(part.phrase(d, at + sum(len(x) for x in part.ids[:d])))
                if p == lo[:len(p)] and p != lo:
                    assert everything[p] == c  # a beginning of the boundary, for the walk
                else:
                    assert lo <= p < hi and p not in seen
                    seen[p] = int(c)
    assert seen == everything
    twice = phrases.merge([trie, phrases.Trie.loads(trie.dumps())])
    assert [x.tolist() for x in twice.counts] == [(2 * x).tolist() for x in trie.counts]


def test_long_texts_are_cut_between_pieces():
    text = b"ab cd. " * 1000 + b"x" * 5000 + b" y! z"
    parts = list(phrases._stretches(text, 1000))
    assert b"".join(parts) == text and all(p[0] in phrases.BREAKS for p in parts[1:]) and len(parts) > 7


def test_nothing_and_large_counts(spark):
    assert result(phrases.collocations(frame(spark, [(t, None) for t in TEXTS[:4]]))) == []
    assert result(phrases.collocations(frame(spark, TEXTS and [("a b", "en")]).limit(0))) == []
    a = 9 * 10**15
    got = spark.sql(f"SELECT (cast({a}L AS decimal(38,0)) * {a}L * 1000000) div (cast({a + 1}L AS decimal(38,0)) * {a + 2}L) AS s").first().s
    assert got == 10**6 * a * a // ((a + 1) * (a + 2))


def test_tries_of_a_range_are_merged_before_they_are_cut():
    """Pieces are as many as ranges, not tries times ranges, which would grow as the square of the text; a task that holds too much cuts in between."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("a ab b ba c".split()) for _ in range(200)).encode()
    texts = [text() for _ in range(6)]
    whole = phrases.count_phrases(texts, 3)
    bounds = sorted(whole.phrase(d, sum(len(x) for x in whole.ids[:d]) + k) for d, k in ((1, 3), (1, 9), (2, 40), (2, 90)))
    rows = [("en", None, 1, b"", phrases.count_phrases([t], 3).dumps(), bounds) for t in texts]
    names = ["lang", "lo", "n", "size", "trie", "bounds"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    for most, pieces in ((10**6, len(bounds) + 1), (1, 6 * (len(bounds) + 1))):
        got = [r for b in phrases._cut(0, most)(iter([batch])) for r in b.to_pylist()]
        assert len(got) == pieces and {tuple(r["lo"] or ()) for r in got} == {(), *map(tuple, bounds)}
        merged = phrases.merge([phrases.Trie.loads(r["trie"]) for r in got])
        assert [x.tolist() for x in merged.ids] == [x.tolist() for x in whole.ids] and merged.counts[2].tolist() == whole.counts[2].tolist()
