import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from tideglass.llm import knn_toxicity as kt


def unit(terms, weights):
    order = np.argsort(terms)
    return np.asarray(terms, np.int64)[order], np.asarray(weights, float)[order] / np.sqrt((np.asarray(weights) ** 2).sum())


@pytest.mark.parametrize("frequent", [0, 8, 512])
def test_block_max_like_brute_force(frequent, monkeypatch):
    monkeypatch.setattr(kt, "FREQUENT", frequent)
    monkeypatch.setattr(kt, "BLOCK", 32)
    rng = np.random.default_rng(3)
    n_terms = 60
    p = 1 / np.arange(1, n_terms + 1)

    def vector():
        t = rng.choice(n_terms, rng.integers(1, 9), replace=False, p=p / p.sum())
        return unit(t, rng.uniform(0.1, 1, len(t)))

    examples = [vector() for _ in range(700)]
    examples += examples[:50]
    digests = np.concatenate([np.arange(700), np.arange(50)])
    cuts = np.concatenate([[0], np.cumsum([len(t) for t, _ in examples])])
    index = kt.BlockMaxIndex(np.concatenate([t for t, _ in examples]), np.concatenate([w for _, w in examples]), cuts, n_terms, digests)
    dense = np.zeros((len(examples), n_terms))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    queries = [vector() for _ in range(80)] + examples[:20] + [(np.empty(0, np.int64), np.empty(0))]
    without = [None] * 80 + list(range(20)) + [None]
    for (t, w), skip, (ids, cosines) in zip(queries, without, index.nearest(queries, 25, without), strict=True):
        scores = dense[:, t] @ w
        scores[digests == skip] = 0.0
        best = np.lexsort((np.arange(len(scores)), -np.round(scores, 12)))[:25]
        best = best[scores[best] > 0]
        assert index.order[ids].tolist() == best.tolist() and np.allclose(cosines, scores[best])


def test_empty_index():
    assert kt.BlockMaxIndex(np.empty(0, np.int32), np.empty(0), np.zeros(1, np.int64), 0).nearest([(np.empty(0, np.int64), np.empty(0))], 5)[0][0].tolist() == []


def test_monotone_curve():
    x, y = kt.monotone(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() <= y.max() <= 1


USE = "crc32(cast(doc_id as string)) % 5 != 0"


def brute(texts, labels, k=kt.K):
    """{id: (score, neighbours)} in plain Python: weights, cosines, votes and curve."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    train = {i: bool(y) for i, _, y in labels if y is not None and crc32(str(i).encode()) % 5 != 0 and i in texts}
    counts = {i: Counter(words(texts[i])) for i in texts}
    vocabulary = {w for i in train for w in counts[i]}
    df = Counter(w for c in counts.values() for w in c if w in vocabulary)
    n, n1 = len(train), sum(train.values())
    factor = {}
    for w in vocabulary:
        a = sum(w in counts[i] for i in train if train[i])
        b = sum(w in counts[i] for i in train if not train[i])
        chi2 = n * (a * (n - n1 - b) - b * (n1 - a)) ** 2 / max((a + b) * (n - a - b) * n1 * (n - n1), 1)
        factor[w] = (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (kt.BASE + math.sqrt(max(chi2 - kt.CHANCE, 0) / n))

    def vector(c):
        v = {w: (1 + math.log(m)) * factor[w] for w, m in c.items() if w in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(c) for i, c in counts.items()}

    def near(i):
        others = [(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in train if texts[j] != texts[i]]
        return sorted(((c, j) for c, j in others if c > 1e-12), key=lambda x: -x[0])[:k]

    def vote(found):
        w = [1 / (kt.NEAR + max(0, 1 - c)) for c, _ in found]
        return sum(x * train[j] for x, (_, j) in zip(w, found)) / sum(w)

    found = {i: near(i) for i in texts}
    fitted = [(vote(found[i]), train[i]) for i in train if found[i]]
    curve = kt.monotone(np.array([v for v, _ in fitted]), np.array([y for _, y in fitted]))
    return {i: (float(np.interp(vote(f), *curve)) if f else (n1 + kt.PRIOR_TOXIC) / (n + kt.PRIOR_ROWS), f) for i, f in found.items()}


def test_query_like_brute_force(spark, sf):
    """Every document of the smallest tables: score, number of neighbours and the nearest one's cosine."""
    from tideglass.llm.queries import op7_knn_toxicity

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = brute(texts, labels)
    rows = op7_knn_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score, found = want[r["doc_id"]]
        assert r["toxic_neighbours"] == len(found) and r["score"] == pytest.approx(score, abs=1e-6)
        if found:
            assert r["toxic_nearest"] == pytest.approx(found[0][0]) and r["evidence"].count(",") == min(len(found), kt.EVIDENCE) - 1
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)


def corpus(n=600):
    rng = random.Random(9)
    bad = ["vile", "foul", "rotten"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = odd.prose(rng, rng.randrange(20, 60)).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_rows(spark):
    rows, labels = corpus()
    docs, marks = odd.documents(spark, rows), odd.labels(spark, labels)
    scorer = kt.fit(docs, marks, F.expr(USE))
    got = {r["doc_id"]: r for r in kt.score_documents(docs, scorer, with_evidence=True).collect()}
    out = [i for i, *_ in labels if crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i]["toxic_score"] >= 0.5) == bool(labels[i][2]) for i in out)
    assert right / len(out) > 0.95
    some = next(i for i in out if labels[i][2])
    nearest = got[some]["toxic_evidence"][0]
    assert labels[nearest["id"]][2] == int(nearest["toxic"]) == 1 and crc32(str(nearest["id"]).encode()) % 5 != 0 and 0 < nearest["cosine"] <= 1.0 + 1e-9


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = odd.documents(spark, rows)
    flipped = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["toxic_score"] for r in kt.score_documents(docs, kt.fit(docs, odd.labels(spark, x), F.expr(USE))).collect()} for x in (labels, flipped))
    assert a == b


def test_bounds_of_the_fit(spark):
    rows, labels = corpus(200)
    docs = odd.documents(spark, rows)
    few = kt.fit(docs, odd.labels(spark, labels), labelled=30)
    assert few.index.n == 30
    small = kt.fit(docs, odd.labels(spark, labels), entries=500)
    assert 0 < len(small.index.terms) <= 500 and small.index.n < 30
    none = kt.fit(docs, odd.labels(spark, labels), entries=1)
    assert none.index.n == 0 and all(r["toxic_score"] < 0.5 for r in kt.score_documents(docs, none).collect())


def test_python_gets_texts_only_piece_by_piece(spark, monkeypatch):
    """Rows stay in the JVM, each text is scored once, and pieces of a batch change nothing."""
    rows, labels = corpus()
    docs = odd.documents(spark, rows)
    scorer = kt.fit(docs, odd.labels(spark, labels))
    for out in (kt.drop_toxic(docs, scorer), kt.score_documents(docs, scorer).where("toxic_score < 0.5")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
    one, many = ({r["doc_id"]: (r["toxic_score"], r["toxic_nearest"]) for r in kt.score_documents(docs.repartition(n), scorer).collect()} for n in (1, 16))
    assert len(rows) > 2 * kt.AT_ONCE and one == many and len(one) == len(rows)
    index = scorer.index
    whole = kt.unit_weights(index.terms, scorer.counts, index.cuts, scorer.factor)
    monkeypatch.setattr(kt, "AT_ONCE", 7)
    assert list(kt.pieces(15)) == [(0, 7), (7, 7), (14, 1)] and list(kt.pieces(0)) == []
    assert (kt.unit_weights(index.terms, scorer.counts, index.cuts, scorer.factor) == whole).all()


def test_odd_rows(spark):
    docs = odd.odd_documents(spark)
    marks = odd.labels(spark, [(1, 1, 1), (1, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 0)])
    out = kt.score_documents(docs, kt.fit(docs, marks))
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(rows) == len(odd.texts()) and all(0 <= r["toxic_score"] <= 1 for r in rows)
    none = kt.fit(docs, odd.labels(spark, []))
    assert all(r["toxic_score"] < 0.5 for r in kt.score_documents(docs, none).collect())
    assert kt.drop_toxic(docs, none).columns == docs.columns and kt.drop_toxic(docs, none).count() == len(odd.texts())
    empty = odd.empty_documents(spark)
    assert kt.score_documents(empty, kt.fit(empty, marks)).count() == 0


def test_clashing_names(spark):
    rows, labels = corpus(60)
    docs = odd.documents(spark, rows).withColumn("toxic_score", F.lit("mine")).withColumn("digest", F.lit(1))
    out = kt.score_documents(docs, kt.fit(docs, odd.labels(spark, labels)), with_evidence=True)
    assert out.columns[: len(docs.columns)] == docs.columns and "toxic_score_" in out.columns
    assert {r["toxic_score"] for r in out.collect()} == {"mine"}
