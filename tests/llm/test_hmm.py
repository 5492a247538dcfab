import math
from collections import Counter
from zlib import crc32

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from tideglass.llm import hmm

def HELD():
    return F.expr("crc32(cast(doc_id as string)) % 5 = 1")


def held(i):
    return i is not None and crc32(str(i).encode()) % 5 == 1


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T.copy())
    ids, starts, lengths = rng.integers(0, 7, 12), np.array([0, 5, 6]), np.array([5, 1, 6])
    got = m.log10(ids, starts, lengths)
    for s, n, g in zip(starts, lengths, got):
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        total = sum(m.pi[p[0]] * np.prod([m.b[ids[s + t], p[t]] for t in range(n)]) * np.prod([m.a[p[t], p[t + 1]] for t in range(n - 1)]) for p in paths)
        assert g == pytest.approx(math.log10(total))


def test_expected_counts_and_rising_likelihood():
    rng = np.random.default_rng(2)
    prior = np.full(6, 1e-9)
    m = hmm.Model.start(np.ones(6), 3)
    ids, lengths = rng.integers(0, 6, 400), np.full(20, 20)
    ids[::2] = ids[1::2]
    starts = np.arange(20) * 20
    last = -np.inf
    for _ in range(6):
        f, s, c = m.expected(ids, starts, lengths)
        assert f.sum() == pytest.approx(20) and s.sum() == pytest.approx(380) and c.sum() == pytest.approx(400)
        score = m.log10(ids, starts, lengths).sum()
        assert score > last - 0.5
        last = score
        m = hmm.Model.of_counts(f, s, c, prior)


def plain_baum_welch(m, texts):
    """Expected counts by the textbook recursions, one text after the other."""
    states = len(m.pi)
    first, steps, classes = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.b)
    for x in texts:
        alpha, beta, scale = np.zeros((len(x), states)), np.ones((len(x), states)), np.zeros(len(x))
        for t, w in enumerate(x):
            alpha[t] = (m.pi if t == 0 else alpha[t - 1] @ m.a) * m.b[w]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        for t in range(len(x) - 2, -1, -1):
            beta[t] = m.a @ (m.b[x[t + 1]] * beta[t + 1]) / scale[t + 1]
        for t, w in enumerate(x):
            classes[w] += alpha[t] * beta[t]
            if t + 1 < len(x):
                steps += alpha[t][:, None] * m.a * (m.b[x[t + 1]] * beta[t + 1])[None] / scale[t + 1]
        first += alpha[0] * beta[0]
    return first, steps, classes


@pytest.mark.parametrize("chunk", [400_000, 700, 90])
def test_pass_like_plain_baum_welch(spark, monkeypatch, chunk):
    """Whole texts, one of them over 1,000 tokens and longer than what is worked on at once."""
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    prior = np.full(9, 0.3)
    m = hmm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4).T.copy())
    texts = [rng.integers(0, 9, n).tolist() for n in (1500, 1, 2, 40, 40, 333, 7, 1, 90)]
    want = plain_baum_welch(m, texts)
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    got = [np.zeros_like(x) for x in want]
    for _, at, n in hmm.lots(starts, lengths):
        for total, x in zip(got, m.expected(ids, at, n), strict=True):
            total += x
    assert all(np.allclose(g, w) for g, w in zip(got, want, strict=True))
    after = hmm.baum_welch_pass(spark.createDataFrame([(t,) for t in texts], "ids array<int>").repartition(3), m, prior)
    best = hmm.Model.of_counts(*want, prior)
    assert np.allclose(after.pi, best.pi) and np.allclose(after.a, best.a) and np.allclose(after.b, best.b)


def test_base_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*hmm.words_of(t), b" "])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in hmm.hmm_scores(docs, HELD(), vocabulary=500).collect()}
    for i, t in rows:
        w = [*hmm.words_of(t), b" "]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_sum_to_one(spark):
    """Over texts of one word: all words of the vocabulary and one unseen word for each rare group cannot pass one."""
    train = [(i, "a b c a b zeta eta") for i in range(40) if not held(i)]
    words = ["a", "b", "c", "zeta", "eta", "unseen", ""]
    test = [(i, w) for i, w in zip([i for i in range(400) if held(i)], words)]
    rows = {r["doc_id"]: r for r in hmm.hmm_scores(odd.documents(spark, train + test), HELD(), vocabulary=3, states=2).collect()}
    assert 0 < sum(10 ** rows[i]["score"] for i, _ in test) < 1


def test_odd_rows(spark):
    rows = hmm.hmm_scores(odd.odd_documents(spark), HELD(), vocabulary=50).collect()
    assert len(rows) == len(odd.texts())
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) and r["n_tokens"] >= 1 for r in rows)
    assert hmm.hmm_scores(odd.empty_documents(spark), HELD()).count() == 0
    only = [i for i in range(50) if held(i)][:3]
    alone = hmm.hmm_scores(odd.documents(spark, [(i, "x y") for i in only]), HELD()).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)
