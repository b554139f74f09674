import itertools
import zlib

import numpy as np
import pytest

from strainshift.llm import factor_machine
from strainshift.llm.factor_machine import RANK, SLOTS, STATS, WORD_SLOTS, Model, features, fit, held_out, score_documents, train
from strainshift.llm.wordhash import WordHasher, batches_of


def test_word_hashes_follow_bytes_split():
    hasher, texts = WordHasher(), [b"", b"  ", b"A b\ta\x0bB\xc3\xa9 \xc3\x89", b"x" * 3_000_000 + b" y", b"a " * 900_000, b"end"]
    words, lengths, counts = hasher.words(texts)
    flat = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and lengths.tolist() == [len(w) for w in flat]
    seen = {}
    for w, h in zip(flat, words.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert list(batches_of([5, 5, 20, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)] and list(batches_of([])) == []


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = Model(0.3, rng.normal(size=SLOTS), rng.normal(size=(SLOTS, RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))
    entries, slots, values = features(WordHasher(), [b"some words, some more words\nand lines", b"", b"ONE"])
    got, _ = model.margin(entries, slots, values.astype(float))
    at = 0
    for k, n in enumerate(entries):
        s, x = slots[at:at + n], values[at:at + n].astype(float)
        assert len(set(s)) == n
        want = 0.3 + (model.weight[s] * x).sum() + sum(
            model.factor[s[i]] @ model.factor[s[j]] * x[i] * x[j] for i, j in itertools.combinations(range(n), 2))
        assert got[k] == pytest.approx(want)
        at += n


def test_features_against_plain_counts():
    text = b"the the cat, sat!\nthe | CAT 12"
    entries, slots, values = features(WordHasher(), [text, b""])
    stat = dict(zip(STATS, values[:entries[0]][slots[:entries[0]] >= WORD_SLOTS]))
    words = text.lower().split()
    assert stat["repeat_next"] == pytest.approx(1 / len(words)) and stat["top_word"] == pytest.approx(3 / len(words))
    assert stat["distinct"] == pytest.approx(len(set(words)) / len(words)) and stat["pipe"] == pytest.approx(1 / len(text))
    assert stat["distinct_pairs"] == pytest.approx(len(set(zip(words, words[1:]))) / len(words))
    assert np.sum(values[:entries[0] - len(STATS)] ** 2) == pytest.approx(1, abs=1e-5)


def test_fit_learns_and_empty_fit():
    texts = [b"good plain words here %d" % i for i in range(150)] + [b"BAD!! BAD!! %d" % i for i in range(150)]
    y = np.array([1.0] * 150 + [0.0] * 150)
    f = features(WordHasher(), texts)
    assert ((fit(*f, y).score(*f) > 0.5) == (y == 1)).all()
    none = fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0))
    assert none.score(*f) == pytest.approx(0.5)


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate([None, "", "x" * 400000, "plain words", "plain words"])] + [(None, "a", 1.0)],
                                 "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1), (None, 1), (2, 0), (1, None), (0, 7)], "doc_id bigint, quality int")
    rows = score_documents(docs, train(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.text or "", r.score) == r.score
    assert score_documents(docs.limit(0), train(docs, labels.limit(0))).count() == 0
    got = {r[0]: r[1] for r in docs.select("doc_id", held_out(docs.doc_id)).distinct().collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in (None, 0, 1, 2, 3, 4)}


def test_held_out_accuracy(spark):
    from strainshift.llm.q_quality import op8_factor_machine
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op8_factor_machine(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    judged = [(rows[d].predicted, q) for d, q in labels if rows[d].held_out]
    assert sum(p == q for p, q in judged) / len(judged) >= 0.95


def test_the_bound_holds_for_rows(spark):
    """One label whose id has very many rows."""
    docs = spark.range(3000).selectExpr("3L AS doc_id", "concat('text ', id % 500, ' words') AS text")
    labels = spark.createDataFrame([(3, 1)], "doc_id bigint, quality int")
    seen = []
    original = factor_machine.fit
    factor_machine.fit = lambda entries, *rest, **more: (seen.append(len(entries)), original(entries, *rest, **more))[1]
    try:
        train(docs, labels, most=10)
        train(docs, labels)
    finally:
        factor_machine.fit = original
    assert seen == [10, 500]
