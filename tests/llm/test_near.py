import random

import pytest

from planarium.llm import near, simhash


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def made(seed=0):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=5)) for _ in range(4000)]
    texts, group = [], []
    for g in range(60):
        base = r.choices(vocab, k=r.randint(150, 400))
        texts.append(" ".join(base))
        group.append(g)
        for _ in range(r.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(max(1, len(base) // 100)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy))
            group.append(g)
    return texts, group


@pytest.mark.parametrize("bucket", [2048, 2])
def test_links_are_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts, _ = made(bucket)
    fps = [near.fingerprint(near.shingles(t)) for t in texts]
    classes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {tuple(r) for r in simhash.links(classes, near.RADIUS, near.PARTS, "node", "fp").collect()}:
        root[find(a)] = find(b)
    mine = [find(x) for x in range(len(fps))]
    root = list(range(len(fps)))
    for i, x in enumerate(fps):
        for j, y in enumerate(fps[:i]):
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= near.RADIUS:
                root[find(i)] = find(j)
    theirs = [find(x) for x in range(len(fps))]
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_planted_copies(spark):
    texts, group = made(7)
    assert min(jaccard(a, b) for a, g in zip(texts, group) for b, h in zip(texts, group) if g == h) > 0.75
    rows = [(10 + i, t, "s") for i, t in enumerate(texts)] + [(1000, texts[0], "s"), (None, texts[0], "s"), (10, texts[0], "s"), (2000, None, "s"), (2001, "", "s"), (2002, "a b", "s"), (2003, "A  b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low string")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, 10 + i)
    assert sorted(map(str, ids)) == sorted(map(str, [*first.values(), None, 2000, 2002]))
    assert near.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("members", [1000, 1])
def test_groups_are_those_of_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(near, "MEMBERS", members)
    monkeypatch.setattr(near, "BLOCK", 300)
    monkeypatch.setattr(near, "PIVOTS", 2)
    monkeypatch.setattr(near, "BUCKET", 1 if members == 1 else 2048)
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdefghij", k=5)) for _ in range(4000)]
    texts = []
    for k in range(240):
        base = r.choices(vocab, k=r.randint(100, 300))
        aim = 0.7 + 0.2 * k / 240
        changed = round((1 - 2 * aim / (1 + aim)) * len(base) / 5)
        copy = list(base)
        for at in r.sample(range(2, len(base) // 5), changed):
            copy[5 * at] = r.choice(vocab)
        texts += [" ".join(base), " ".join(copy)]
    chain = r.choices(vocab, k=200)
    for k in range(12):  # each is near the next, the ends have nothing in common
        texts.append(" ".join(chain))
        chain = chain[15:] + r.choices(vocab, k=15)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in [i - 1] if i % 2 or i > 480 else []:
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[i] = root[j]
    assert 60 < sum(root[2 * k] == root[2 * k + 1] for k in range(240)) < 180 and root[-1] == 480
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, near.groups(docs).collect())) == dict(enumerate(root))


def test_rows_of_one_doc_id(spark):
    unlike = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
    rows = [(1, unlike[0], "x", 1), (1, unlike[1], "x", 2), (1, unlike[1], "x", 2), (2, unlike[1], "y", 3), (3, "few words", "z", 4), (3, "few words", "y", 4), (3, "few words", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, told int")
    first = sorted(map(tuple, near.keep_one(docs).collect()), key=str)
    assert [r[:2] for r in first] == sorted([(1, unlike[0]), (1, unlike[1]), (3, "few words")])
    again = spark.createDataFrame(rows[::-1], docs.schema).repartition(5)
    assert sorted(map(tuple, near.keep_one(again).collect()), key=str) == first
