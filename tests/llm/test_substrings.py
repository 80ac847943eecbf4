import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from planarium.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, n=13):
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (d, _), words in zip(rows, split):
        for i in range(len(words) - n + 1):
            if d is not None:
                key = tuple(words[i : i + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - n + 1):
            if d is not None and first[tuple(words[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdé.", k=r.randint(1, 6))) for _ in range(60)]
    passages = [r.choices(vocab, k=r.randint(10, 40)) for _ in range(12)]
    rows = []
    for k in range(120):
        words = r.choices(vocab, k=r.randint(0, 50))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            words += p[a:] if r.random() < 0.5 else p
            words += r.choices(vocab, k=r.randint(0, 20))
        rows.append((k * 7 % 131, r.choice([" ", "  ", "\n", "\t\x0b"]).join(words)))
    rows += [(1000, "a " * 400), (1001, "a " * 30 + "b " * 30), (999, "a " * 13), (2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (5000, rows[5][1]), (5001, "x y z " * 20), (4, "x y z " * 20)]
    return rows


@pytest.mark.parametrize("seed,words,stretch", [(1, 250_000, 64), (2, 100, 64), (3, 250_000, 14), (4, 250_000, 5)])
def test_against_plain(spark, monkeypatch, seed, words, stretch):
    monkeypatch.setattr(substrings, "PATTERN_WORDS", words)
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1500)
    rows = made(seed)
    docs = spark.createDataFrame([(t, d, "r", 3) for d, t in rows], "text string, doc_id long, rest string, bucket int")
    got = substrings.remove_repeats(docs)
    assert got.columns == ["text", "doc_id", "rest", "bucket", "n_words", "n_removed", "kept_sha256"]
    got = got.collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got])) == sorted(map(str, plain(rows)))
    texts = {t for _, t in rows}
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == r.kept_sha256
        assert r.n_removed or r.text in texts
        assert (r.rest, r.bucket) == ("r", 3)
    assert any(r.n_removed for r in got)


def test_only_words_decide(spark, monkeypatch):
    """Windows that all have one name are proposed for one another, and nothing goes that isn't in the first document."""
    monkeypatch.setattr(substrings.Windows, "names", lambda self, chosen=slice(None): (np.zeros(len(self.at[chosen]), np.uint64), np.zeros(len(self.at[chosen]), np.uint32)))
    docs = [(k, " ".join(f"{c}{n}" for n in range(40)), "x") for k, c in enumerate("abcdea")]
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, n_words string"), names=("w", "r", "h"))
    assert got.columns == ["doc_id", "text", "n_words", "w", "r", "h"]
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[k].r for k in range(5)] == [0] * 5 and {r.n_words for r in rows.values()} == {"x"}


def test_a_passage_of_which_documents_hold_parts():
    words = [f"w{k}".encode() for k in range(200)]
    docs = [words[3:16], words[10:40] + [b"z"] + words[40:60], words[150:], [b"z"] * 5, words[20:32], words]
    passages = [(words[k : k + 64], 5) for k in range(0, 188, 52)]
    got = substrings.covered(docs, np.array([9, 9, 7, 6, 8, 5]), passages, 13, 7)
    assert [int(g.sum()) for g in got] == [13, 50, 50, 0, 0, 0] and not got[1][30]
    repeated = [[b"a"] * 300, [b"a"] * 12, [b"a", b"b"] * 30]
    got = substrings.covered(repeated, np.array([2, 3, 4]), [([b"a"] * 13, 1), ([b"b", b"a"] * 7, 1)], 13, 7)
    assert [int(g.sum()) for g in got] == [300, 0, 60]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert substrings.remove_repeats(docs).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert substrings.remove_repeats(one).first().n_removed == 0


def test_memory_does_not_grow_with_the_phrases_found(monkeypatch):
    monkeypatch.setattr(substrings, "SPAN", 1 << 12, raising=False)
    monkeypatch.setattr(substrings, "CELLS", 1 << 15)
    words, peaks = [b"a"] * 10_000, []
    for n in (2, 8):
        tracemalloc.start()
        got = substrings.covered([words] * n, np.arange(1, n + 1), [([b"a"] * 64, 0)], 13, 7)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert all(g.all() for g in got)
    assert peaks[1] - peaks[0] < 60_000 * 60  # of 60,000 words more, at most 60 bytes each; a phrase found took over 100


def test_windows_of_a_passage_share_patterns(monkeypatch):
    """An automaton of one pattern for each window took as long to build as all documents took to search."""
    built, made = [], substrings.ahocorasick.Automaton
    monkeypatch.setattr(substrings.ahocorasick, "Automaton", lambda: built.append(made()) or built[-1])
    words = [f"w{k}".encode() for k in range(640)]
    passages = [(words[k : k + 64], 1) for k in range(0, 640, 64)]
    docs = [words, words[5:18], [w for k in range(0, 640, 64) for w in [b"z", *words[k + 51 : k + 64]]], words[60:69]]
    got = substrings.covered(docs, np.array([2, 3, 4, 5]), passages, 13, 7)
    assert [int(g.sum()) for g in got] == [640, 13, 130, 0]
    assert sum(map(len, built)) <= 640 / 7 + 1


def test_cut_against_plain():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choices("ab \t\n\x0b\x1c\x85\u3000é", k=r.randint(0, 30)))
        words = text.encode().split()
        gone = np.array([r.random() < 0.4 for _ in words], bool)
        parts = re.findall("([\x20\x09-\x0d]*)([^\x20\x09-\x0d]+)", text)  # a word that goes takes the space before it
        left = "".join(space + word for (space, word), g in zip(parts, gone) if not g)
        tail = text[len(text.rstrip("\x20\t\n\x0b\x0c\r")) :]
        want = (left + tail).lstrip("\x20\t\n\x0b\x0c\r") if gone.any() else text
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        assert substrings._cut(text, words, gone) == (want, hashlib.sha256(kept).hexdigest())
