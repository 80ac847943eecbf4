import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from planarium.llm import simhash


def plain_fingerprint(text, k=3):
    words = []
    for part in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" "):
        for c in "\t\n\x0b\x0c\r":
            part = part.replace(c, " ")
        words += [w for w in part.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    names = sorted(set(fps))
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            if (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    return {x: find(x) for x in names}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b", "A b C d", "Été éTÉ x y z", "w " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(text) == plain_fingerprint(text)


def planted(seed=0, n=60):
    r = random.Random(seed)
    fps = [0]
    for _ in range(n):
        base = r.getrandbits(64)
        fps.append(base)
        for _ in range(r.randrange(6)):
            base ^= sum(1 << b for b in r.sample(range(64), r.randrange(5)))
            fps.append(base)
    return list(dict.fromkeys(fps))


@pytest.mark.parametrize("bucket", [8192, 2])
def test_links_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = planted(bucket) + [7 << 40 | x for x in range(40)]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {tuple(r) for r in simhash.links(table).collect()}
    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    true = plain_components(fps)
    mine = {}
    for x, s in zip(fps, signed):
        mine.setdefault(find(s), set()).add(x)
    theirs = {}
    for x in fps:
        theirs.setdefault(true[x], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_near_duplicates(spark):
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    base = [r.choice(vocab) for _ in range(300)]
    texts = [" ".join(base), " ".join(base), " ".join(base).upper(), " ".join([*base[:299], "zz"]), None, "", " \n", "x"]
    texts += [" ".join(r.choices(vocab, k=80)) for _ in range(20)]
    rows = [(100 - i, t, i) for i, t in enumerate(texts)] + [(None, "x", 0), (93, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    root = plain_components(fps)
    least = {}
    for (d, _, _), f in zip(rows, fps):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = [(d, f - (1 << 64) if f >> 63 else f, None if d is None else least[root[f]]) for (d, _, _), f in zip(rows, fps)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_forest():
    left, right = np.array([5, 1, 2, 8]), np.array([4, 2, 3, 9])
    assert simhash.forest(left, right, 10).tolist() == [0, 1, 1, 1, 4, 4, 6, 7, 8, 8]


def test_query_has_all_rows(spark):
    from planarium.llm.queries import op2_simhash_near_dedup

    got = op2_simhash_near_dedup(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.count() == docs.count()
    assert got.where(F.length("fingerprint") != 16).count() == 0
