import hashlib
import itertools
import re

import pytest

import corpus_pipeline as p

def _near_groups(texts):
    """The smallest doc_id reachable over pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    words = {d: re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for d, t in texts.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(texts), 2):
        if sets[x] == sets[y] or 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


@pytest.fixture(scope="module")
def steps(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, path), name)
        out.append(docs)
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == before.columns and after.schema == before.schema
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert 0 < steps[-1].count() == steps[-2].count()


def test_each_stage_against_plain(spark, steps):
    from test_decontaminate import plain as align
    from test_substrings import WORD
    from test_substrings import plain as cut

    from planarium.llm.decontaminate import words_of

    near, cleaned, clean = ({r.doc_id: r.text for r in s.collect()} for s in steps[2:5])
    want = {d: h for d, _, _, h in cut(list(near.items()))}
    assert {d: hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest() for d, t in cleaned.items()} == want
    assert any(cleaned[d] != t for d, t in near.items())
    rated = {r.doc_id: r.text for r in steps[1].collect()}
    assert sorted(near) == sorted(set(_near_groups(rated).values()))
    bench = [words_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    for d, t in list(cleaned.items())[:40]:
        words = words_of(t)[:400]
        leaks = any(align(b, words) >= len(b) for b in bench if len(set(b) & set(words)) * 2 > len(set(b)))
        assert not (leaks and d in clean)
    for r in steps[-1].collect():
        assert r.lossless and r.text_sha256 == hashlib.sha256((clean[r.doc_id] or "").encode()).hexdigest()


def test_edges_of_every_stage(spark):
    path = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").limit(25).collect()
    long = " ".join(f"word{k % 977}" for k in range(60000))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    rows += [(900, None, "en", None, 0), (901, "", None, "s", None), (None, given[0].text, "en", "s", 7), (902, long, "en", "s", len(long)), (None, None, None, None, None), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "mine", k % 3, [k], "x", 1.5) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, n_words string, root int, Kept_SHA256 array<int>, told string, bucket double")
    for name, stage in p.STAGES:
        found = stage(spark, docs, path)
        none = stage(spark, docs.limit(0), path)
        assert none.count() == 0 and none.columns == found.columns
        if name == "sentencepiece":
            assert found.count() == len(rows) and found.where("not lossless").count() == 0
            continue
        assert found.columns == docs.columns and found.schema == docs.schema
        got = found.collect()
        assert got and all(r.n_words == "mine" and r.told == "x" and r.bucket == 1.5 for r in got)
        if name == "near_dedup":
            assert sum(r.doc_id is None for r in got) == 2 and len([r for r in got if r.doc_id in (900, 901)]) == 1
            assert len([r for r in got if r.doc_id == rows[3][0]]) <= 1
        if name == "substring_dedup":
            assert len(got) == len(rows) and sum(r.text is None for r in got) == 2
