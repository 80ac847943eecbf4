import itertools
import math

import numpy as np

from planarium.llm import language
from planarium.llm.queries import op3_language_id

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]


def cuts(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        piece = word[:k]
        if piece in PIECES or k == 1:
            for rest in cuts(word[k:]):
                yield [piece, *rest]


def test_forward_sums_all_cuts():
    r = np.random.default_rng(0)
    p = np.r_[r.random((len(PIECES), 2)), [[1e-7, 1e-7], [0, 0]]]
    words = ["a", "ab", "aba", "abab", "xb", "b" * 31] + ["".join(w) for w in itertools.product("abx", repeat=4)]
    got = language.Lattice(PIECES).likelihoods(words, p)
    for w, row in zip(words, got):
        for lang in range(2):
            want = sum(math.prod(p[PIECES.index(x) if x in PIECES else len(PIECES), lang] for x in cut) for cut in cuts("▁" + w))
            assert math.isclose(row[lang], math.log(want), rel_tol=1e-9)


def test_shares_are_expectations():
    words, times = ["aba", "ab"], np.array([[2, 0], [1, 3]])
    got = language.Lattice(PIECES).shares(words, times)
    want = np.zeros_like(got)
    for w, t in zip(words, times):
        every = [(c, (1 / len(PIECES)) ** len(c)) for c in cuts("▁" + w)]
        total = sum(x for _, x in every)
        for c, x in every:
            for piece in c:
                want[PIECES.index(piece) if piece in PIECES else len(PIECES)] += t * x / total
    assert np.allclose(got, want)


def test_words():
    assert language.words_of("Été 12 don't x_y " + "z" * 70) == ["été", "don", "t", "x", "y", "z" * 31, "z" * 31, "z" * 8]
    assert language.words_of(None) == language.words_of("12 --") == language.words_of("½ ²½ ① Ⅷ ൰ 𐄇") == []
    assert language.words_of("m² Ⅷème a①b 漢字") == ["m", "ème", "a", "b", "漢字"]


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !", "de"), (4, "hello", None), (None, "hello there", "en"), (4, "bonjour le monde", "fr"), (5, "字" * 5000, "zh")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    langs, p = language.learn(docs)
    assert langs == ["en", "fr", "zh"]  # the text in "de" has no word to learn from
    got = language.predict(docs, (langs, p)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.lang_pred) for r in got} >= {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "fr"), (5, "zh")}
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.doc_id, r.held_out) for r in docs.select("doc_id", language.held_out().alias("held_out")).collect()} >= {(None, True)}
    numerals = spark.createDataFrame([(1, "½"), (2, "²½ ①")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language.predict(numerals, (langs, p)).collect()} == {("und", 0.0)}
    nothing = language.learn(docs.limit(0))
    assert nothing[0] == []
    assert {(r.lang_pred, r.score) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = op3_language_id(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert got.count() == docs.count()
    both = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    right = both.where("lang = lang_pred").count() / both.count()
    assert right > 0.95, right


def test_many_languages_in_blocks():
    r = np.random.default_rng(1)
    p = np.r_[r.random((len(PIECES), 40)), np.full((1, 40), 1e-7), np.zeros((1, 40))]
    words = ["a", "ab", "aba", "xb"]
    lattice = language.Lattice(PIECES)
    assert np.allclose(lattice.likelihoods(words, p), np.stack([lattice.likelihoods(words, p[:, k : k + 1])[:, 0] for k in range(40)], 1))


def test_order_of_rows_makes_no_difference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    one, two = language.learn(docs.repartition(1)), language.learn(docs.orderBy("text").repartition(5))
    assert one[0] == two[0] and np.allclose(one[1], two[1], rtol=1e-4)


def test_tasks_make_no_difference(spark):
    docs = spark.createDataFrame([(f"Haus Baum rare{chr(97 + k % 23)} und wort{chr(97 + k % 7)}", "de") for k in range(300)], "text string, lang string")
    one, many = language.learn(docs.repartition(1)), language.learn(docs.repartition(40))
    assert one[0] == many[0] and np.array_equal(one[1], many[1])
