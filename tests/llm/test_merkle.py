"""The Merkle manifest against a plain recursive tree, and on odd rows."""

import hashlib
import random
import zlib

import pytest

from mosaiq.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, block long, root string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root of nodes, and for each of them its (siblings before, siblings after) level by level."""
    paths = [[] for _ in nodes]
    held, under = nodes, [[k] for k in range(len(nodes))]
    while len(held) > 1:
        up, above = [], []
        for k in range(0, len(held), fanout):
            run = held[k:k + fanout]
            for j in range(len(run)):
                for x in under[k + j]:
                    paths[x].append((run[:j], run[j + 1:]))
            up.append(digest("".join(run)))
            above.append([x for xs in under[k:k + fanout] for x in xs])
        held, under = up, above
    return held[0], paths


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        groups[lang] = own, *tree([leaf(r) for r in own], fanout)
    root, tops = tree([groups[lang][1] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, paths = groups[lang]
        for r, path in zip(own, paths, strict=True):
            path = path + top
            h = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in path:
                h = digest("".join(before) + h + "".join(after))
            proof = "".join(x for before, after in path for x in before + after)
            out.append((r[0], leaf(r), subroot, root, proof, h, h == root))
    return sorted(out, key=str)


def table_of(rng, n):
    langs = ["en"] * 6 + ["de", "fr", "", "é", "zz", None]
    rows = [(k if rng.random() < 0.97 else None, rng.choice(["a", None, "src é"]), rng.choice(langs), rng.choice([None, 0, k, 2**63 - 1]), rng.choice([None, "", f"text {k}", "😀" * 3])) for k in range(n)]
    return [(*r, 1, "x") for r in rows + rows[:5] + [rows[7]] * 30]


def manifest(spark, rows, fanout):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fields = [F.col(c) for c in merkle.FIELDS]
    changed = [(F.col("n_chars").cast("decimal(20,0)") + 1).cast("string") if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest(changed)).otherwise(merkle.leaf_digest(fields))
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(fields).alias("leaf"), tampered.alias("tampered"))
    return merkle.folded(merkle.merkle_manifest(leaves, "lang", ["doc_id"], fanout), "tampered")


@pytest.mark.parametrize(("fanout", "block", "n"), [(2, 1024, 60), (2, 4, 150), (3, 9, 150), (2, 2, 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, fanout, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = table_of(random.Random(n), max(n, 8))[:n if n == 1 else None]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.folded_root == r.root) for r in manifest(spark, rows, fanout).collect()]
    assert sorted(got, key=str) == brute(rows, fanout)


def test_query_on_odd_tables(spark, tmp_path):
    rows = table_of(random.Random(5), 40)
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = merkle.op12_merkle(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        want = [(d, own, sub, root, digest(proof), folded, same) for d, own, sub, root, proof, folded, same in brute(part, 2)] if part else []
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_clashing_columns_are_told(spark):
    with pytest.raises(ValueError, match="root"):
        merkle.merkle_manifest(spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, lang string, leaf string, root string"), "lang", ["doc_id"])


def test_a_long_text(spark):
    from pyspark.sql import functions as F

    text = "ö" * 3_000_000
    got = spark.createDataFrame([(text,)], "text string").select(merkle.leaf_digest([F.col("text")])).first()[0]
    assert got == digest(f"6000000:{text}")
