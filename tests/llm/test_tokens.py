import functools
import hashlib
import tracemalloc

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from planarium.llm import dropout, pieces, token_counts

TEXTS = [None, "", " ", "  ", "a", "Hello  world ", "   three   spaces", "▁ mark▁▁", "<s> </s> <unk> <0x0A>", "tab\tnew\nline\r\n", "数字 漢字 ελληνικά 🙂🙂", "x" * 3000, "1234567 890", "word " * 500, "\x00\x7f "]


@functools.cache
def encoder(rate):
    return dropout.Encoder(pieces.load(), rate, 5)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_counts_equal_the_library(library, model):
    counts = token_counts.Counts(model.ranks)
    for t in TEXTS:
        assert counts.of(t) == len(library.encode(t or "")), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" ▁abeinrst.\nTh")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    model = pieces.load()
    assert token_counts.Counts(model.ranks).of(text) == len(library.encode(text))
    for rate in (0.0, 0.3, 1.0):
        ids = np.frombuffer(encoder(rate).text(text, 9), np.int32)
        assert dropout.Decoder(model).text(ids) == text
        if "▁" not in text:
            assert library.decode(ids.tolist()) == text
            if rate == 0:
                assert ids.tolist() == library.encode(text)


def test_agendas_side_by_side_merge_as_one_alone(model):
    import random

    r = random.Random(2)
    words = ["▁" + "".join(r.choices("theraniongsdé.", k=r.randint(1, 31))) for _ in range(2000)] + ["▁" * 16, "▁" * 9 + "the"]
    words += ["▁x\n", "▁漢", "▁" + "long" * 12]
    for rate in (0.0, 0.1, 0.5, 1.0):
        encoder = dropout.Encoder(model, rate, 3)
        index = np.array([encoder.known[w] for w in words] * 3)[r.sample(range(3 * len(words)), 2 * len(words))]
        keys = np.array([r.getrandbits(32) for _ in index], np.uint32)
        for low, high in ((0, 1500), (1500, len(index))):  # runs seen once, then again
            found, size = encoder.block(index[low:high], keys[low:high])
            parts = np.split(found, np.cumsum(size)[:-1])
            for k, key, part in zip(index[low:high].tolist(), keys[low:high].tolist(), parts):
                assert part.tolist() == encoder._alone(encoder.names[k], key), (rate, encoder.names[k])


def test_seeds_vary(model):
    text = "the tokenization of several words varies between seeds " * 5
    cuts = {dropout.Encoder(model, 0.2, seed).text(text, 1) for seed in range(5)}
    assert len(cuts) == 5
    assert dropout.Encoder(model, 0.2, 3).text(text, 1) == dropout.Encoder(model, 0.2, 3).text(text, 1)
    assert dropout.Encoder(model, 0.2, 3).text(text, 1) != dropout.Encoder(model, 0.2, 3).text(text, 2)
    assert len(dropout.Encoder(model, 0.2, 3).text(text, 1)) > len(dropout.Encoder(model, 0, 3).text(text, 1))


def test_every_occurrence_is_cut_afresh(model):
    n, word = 4000, "tokenization"
    encoder = dropout.Encoder(model, 0.1, 17)
    encoder.batch(["some other text"], [7])
    found, ends = encoder.batch([" ".join([word] * n)], [1])
    decoder = dropout.Decoder(model)
    assert decoder.text(found) == " ".join([word] * n)
    whole, size = encoder.block(np.full(n, encoder.known[word]), dropout._mixed(np.arange(n, dtype=np.uint32)))
    kinds = {tuple(x) for x in np.split(whole, np.cumsum(size)[:-1])}
    assert len(kinds) > 20
    keys, merges = dropout._mixed(np.arange(n, dtype=np.uint32)), encoder.merges.take(np.array([encoder.known[word]]))[0]
    skipped = dropout._skips(np.repeat(keys, len(merges)), np.tile(merges, n), 0.1).reshape(n, -1)
    assert np.abs(skipped.mean(0) - 0.1).max() < 0.02 and abs((~skipped).all(1).mean() - 0.9 ** len(merges)) < 0.03


def test_blocks_and_memory_make_no_difference(model, monkeypatch):
    text = " ".join(f"word{k % 91} again" for k in range(3000)) + "  x\n"
    want = dropout.Encoder(model, 0.1, 17).text(text, 5)
    monkeypatch.setattr(dropout, "BLOCK", 100)
    monkeypatch.setattr(dropout, "REMEMBERED", 50)
    encoder = dropout.Encoder(model, 0.1, 17)
    assert encoder.text("word1 word2", 4) and encoder.text(text, 5) == want and encoder.text(text, 5) == want


def test_memory_of_runs_is_bounded(model):
    """Words that never recur leave little behind: two workers and the JVM share an executor."""
    encoder = dropout.Encoder(model, 0.1, 17)
    tracemalloc.start()
    try:
        for at in range(0, 240_000, 10_000):
            encoder.batch([" ".join(f"{k:x}" for k in range(at, at + 10_000))], [at])
        held = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert held < 60, held


def test_tables(spark, library):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "a b", 0), (3, None, 1), (4, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, limit=100).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for d, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    encoded = dropout.encode(docs)
    back = dropout.decode(encoded).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)
    both = dropout.round_trip(docs).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in both) == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert {(r.doc_id, tuple(r.token_ids)) for r in both} == {(r.doc_id, tuple(r.token_ids)) for r in encoded.collect()}
    assert token_counts.count_tokens(docs.limit(0)).count() == dropout.encode(docs.limit(0)).count() == 0
