import math
import random
import re
import unicodedata

import odd
import pytest
from pyspark.sql import functions as F

from tideglass.llm import mixing


def corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        junk = i % 4 == 0
        words = odd.prose(rng, rng.randrange(10, 80)).split()
        rows.append((i, " ".join(w + ("###" if junk else "") for w in words)))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    return rows, labels


def halves(natural):
    return {d: 0.5 for d in natural}


def test_targets_are_met(spark):
    rows, labels = corpus()
    docs, marks = odd.documents(spark, rows), odd.labels(spark, labels)
    found = mixing.mixture(docs, marks, F.col("quality"), halves)
    out = found.table.collect()
    assert [d for d, *_ in found.report] == found.classifier.domains == ["0", "1"]
    totals = [sum(r["tokens"] * r["rate"] * r["p"][d] for r in out) for d in (0, 1)]
    tokens = sum(r["tokens"] for r in out)
    assert totals == pytest.approx([tokens / 2] * 2, rel=1e-3) and totals == pytest.approx([r[3] for r in found.report])
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in out)
    truth = {i: int(i % 4 != 0) for i, _ in rows}
    assert sum((r["p"][1] > 0.5) == bool(truth[r["row"]["doc_id"]]) for r in out) / len(out) > 0.95
    rows_, accuracy, loss = found.classifier.held_out
    assert rows_ > 20 and accuracy > 0.9 and loss < 0.4


def test_rates_have_a_bound_and_misses_are_told(spark):
    rows, labels = corpus()
    found = mixing.mixture(odd.documents(spark, rows), odd.labels(spark, labels), F.col("quality"), lambda n: {"0": 0.9, "1": 0.1}, total=3.0, most=2.0)
    out = found.table.collect()
    assert max(r["rate"] for r in out) <= 2.0 and max(r["copies"] for r in out) <= 2
    (_, _, target, reached), _ = found.report
    assert reached < 0.9 * target


def plain_posterior(model, text):
    """The classifier in plain Python, given its buckets."""
    import math
    import re

    tokens = text.split()
    terms = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]
    n = max(1, len(text))
    count = max(1, len(tokens))
    x = [math.log1p(count), n / count, sum(not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-") for c in text) / n, sum(c in "0123456789" for c in text) / n, sum(c.isupper() for c in text) / n, len(set(terms)) / max(1, len(terms))]
    return x, terms


def test_query_like_brute_force(spark, sf):
    """Features, posteriors, rates and copies of all documents of the smallest tables, outside Spark."""
    import math

    from tideglass.llm import queries

    docs, labels = queries.language_and_quality(spark, sf)
    found = mixing.mixture(docs, labels, F.col("domain"), queries.even_languages, keep=("doc_id", "source"), most=queries.MOST_COPIES)
    model, texts = found.classifier, {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    every = sorted({t for text in texts.values() for t in plain_posterior(model, text)[1]})
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    power, factor = model.temper
    want, totals = {}, [0.0] * len(model.domains)
    for i, text in texts.items():
        x, terms = plain_posterior(model, text)
        logs = []
        for d in range(len(model.domains)):
            surface = model.priors[d] + sum(model.tables[d][j][sum(v > e for e in model.edges[j])] for j, v in enumerate(x))
            logs.append(surface + sum(round(model.weights[d][bucket[w]], 4) for w in terms) * factor / max(1, len(terms)) ** power)
        q = [math.exp(v - max(logs)) for v in logs]
        want[i] = [v / sum(q) for v in q]
    rows = {r["row"]["doc_id"]: r for r in found.table.collect()}
    near = [max(abs(a - b) for a, b in zip(rows[i]["p"], want[i])) < 1e-3 for i in texts]
    assert rows.keys() == texts.keys() and sum(near) >= 0.99 * len(near)
    for r in rows.values():
        totals = [t + r["tokens"] * r["rate"] * p * (r["tokens"] > 0) for t, p in zip(totals, r["p"])]
        assert 0 <= r["rate"] <= queries.MOST_COPIES and abs(r["copies"] - r["rate"]) < 1
    assert totals == pytest.approx([reached for *_, reached in found.report], rel=1e-6)
    out = {r["doc_id"]: r for r in queries.op8_soft_membership_mixing(spark, sf).collect()}
    assert out.keys() == texts.keys()
    assert all(o["rate"] == pytest.approx(rows[i]["rate"], abs=1e-5) and o["n_tokens"] == len(texts[i].split()) and o["posterior"] == pytest.approx(max(rows[i]["p"]), abs=1e-5) for i, o in out.items())


@pytest.mark.parametrize("n_domains", [1, 2, 5])
@pytest.mark.parametrize("most", [1 << 31, 1 << 20])
def test_words_are_gone_through_once_for_two_domains(spark, n_domains, most, monkeypatch):
    """Exact sums, also of texts whose words are summed part by part, and of none."""
    monkeypatch.setattr(mixing, "HALF", most, raising=False)
    rng = random.Random(8)
    weights = [[rng.uniform(-12, 9) for _ in range(64)] for _ in range(n_domains)]
    model = mixing.Classifier([str(d) for d in range(n_domains)], [0.0] * n_domains, [], [], weights)
    texts = [[rng.randrange(64) for _ in range(n)] for n in (0, 1, 4, 5, 6, 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, words array<int>")
    got = {r["i"]: r["e"] for r in rows.select("i", model.evidence(F.col("words")).alias("e")).collect()}
    for i, words in enumerate(texts):
        assert got[i] == pytest.approx([sum(round(w[b], 4) for b in words) for w in weights], abs=1e-9)
    assert sum(len(g) for g in got.values()) == n_domains * len(texts)


def test_classes_of_characters(spark):
    """The listed characters are those of the classes they stand for."""
    every = spark.range(1, 0x3000).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for own, java in ((f"[{mixing.BLANK}]", r"\s"), (f"[{mixing.MARKS}]", r"[\s\p{Punct}]")):
        assert every.where(F.col("c").rlike(own) != F.col("c").rlike(java)).count() == 0 < every.where(F.col("c").rlike(own)).count()


def test_features_like_plain_python(spark):
    """The classes of a text's characters are counted in what is left of it; its words have no empty ones."""
    texts = ["", " \n", "...", "plain words only", " Ünï Ω9 ²x ß-A, ... (b) ", "a\tb\u00a0c #tag @x 12,5%", "É\u00c9 \U0001f600\U0001f600z", "UPPER 007", "--a--b c--\n"]
    texts = [t.replace("\\n", "\n") for t in texts]
    found = mixing.add_features(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    assert found.columns == ["i", "text", "tokens", "x", "words"]
    assert found.select("x")._jdf.queryExecution().optimizedPlan().toString().count("[abcdefghijklmnopqrstuvwxyz") == 1
    for r in found.collect():
        t = r["text"]
        tokens, terms = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w], [w for w in re.split(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", t.lower()) if w]
        kinds = [unicodedata.category(c) for c in t]
        symbols = sum(k[0] not in "LN" and c not in " \t\n\x0b\f\r.,;:!?'\"()-" for c, k in zip(t, kinds))
        n, count = max(1, len(t)), max(1, len(tokens))
        want = [math.log1p(count), n / count, symbols / n, sum(c in "0123456789" for c in t) / n, kinds.count("Lu") / n, len(set(terms)) / max(1, len(terms))]
        assert r["x"] == pytest.approx(want) and r["tokens"] == len(tokens) and len(r["words"]) == len(terms), t


def test_like_plain_descent(spark):
    """Rates against the same steps in plain Python, with some documents pushed to zero."""
    table = [(float(3 + i % 7), [0.9, 0.1] if i % 3 else [0.2, 0.8]) for i in range(60)]
    targets = [1.0, 400.0]
    steps, totals = mixing.fit_rates(spark.createDataFrame(table, "tokens double, p array<double>"), targets, steps=6)
    rates = [1.0] * 60
    for g in steps:
        rates = [max(0.0, r - sum(a * b for a, b in zip(g, p))) for r, (_, p) in zip(rates, table)]
    assert totals == pytest.approx([sum(r * t * p[d] for r, (t, p) in zip(rates, table)) for d in (0, 1)])
    assert min(rates) == 0.0


def test_clean_documents_stay(spark):
    rows, labels = corpus()
    out = mixing.mix(odd.documents(spark, rows), odd.labels(spark, labels), F.col("quality"), lambda n: {d: s * {"0": 0.5}.get(d, 1.0) for d, s in n.items()})
    kept = {r["doc_id"] for r in out.collect()}
    assert {i for i, _ in rows if i % 4} <= kept and len(kept) < len(rows)


def test_odd_rows(spark):
    docs = odd.odd_documents(spark)
    marks = odd.labels(spark, [(1, 1, 0), (1, 0, 0), (3, 0, 0), (7, None, None), (None, 1, 1), (11, 1, 0)])
    same = lambda natural: natural
    assert mixing.mix(docs.withColumn("rate", F.lit("a")).withColumn("copies", F.lit("b")).withColumn("x", F.lit(1)), marks, F.col("quality"), same).first()["rate"] == "a"
    out = mixing.mix(docs, marks, F.col("quality"), same)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(docs, odd.labels(spark, []), F.col("quality"), same).count() == docs.count()
    empty = odd.empty_documents(spark)
    assert mixing.mix(empty, marks, F.col("quality"), same).count() == 0
