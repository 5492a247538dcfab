"""Steps that must grow with the input only: their results by brute force, and plans without the rows that made them slow."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tideglass.functions import draws, lexicon
from tideglass.operators import dedup
from tideglass.operators import signal as sg
from tideglass.operators import vectors
from tideglass.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_compile_no_pattern_per_row(spark):
    df = spark.range(1).select(F.when(F.col("id") == 0, "never buy on dips, sell").alias("t")).select(lexicon.term_weights(F.col("t")).alias("w"))
    assert "split(" not in plan(df) and df.first()["w"] == [-lexicon.LEXICON["buy on dips"], lexicon.LEXICON["sell"]]


def test_tree_of_terms_finds_what_the_list_finds():
    listed = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, lexicon.LONGEST_FIRST)) + r")(?!\w)")
    tree = re.compile(r"(?<!\w)(" + lexicon.one_of(lexicon.LONGEST_FIRST) + r")(?!\w)")
    for a in lexicon.LONGEST_FIRST:
        for b in ("", " in control", "s", "ing pressure", " high", " on dips"):
            text = f"x {a}{b}. {a}"
            assert listed.findall(text) == tree.findall(text)


def test_scores_of_one_file_are_dealt_to_every_core(spark, sf):
    assert registry.scored(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_md5_draws():
    for n in (1, 10, 1234):
        for head in ("42:1704067200", "x" * 50):
            for replicates, low, _, h in draws.md5_draws(head, range(8, 12), n):
                for r in replicates:
                    for i in range(0, h.shape[1], 37):
                        assert int(hashlib.md5(f"{head}:{r}:{low + i}".encode()).hexdigest()[:8], 16) == h[r - replicates.start][i]


def test_bootstrap_makes_no_row_of_a_draw(spark):
    rows = [(g, 100 - i, 0.1 * i - g, 1.0 + i % 3, i % 4 > 0) for g, n in ((1, 9), (2, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v double, w double, k boolean")
    found = sg.bootstrap(df, "g", "v", "w", "i", resamples=50, keep=F.col("k"))
    assert "Join" not in plan(found) and "explode" not in plan(found)
    got = {r["g"]: (r["ci_low"], r["ci_high"]) for r in found.collect()}
    for g in (1, 2):
        kept = sorted((i, v, w) for a, i, v, w, k in rows if a == g and k)
        means = []
        for r in range(50):
            drawn = [kept[int(hashlib.md5(f"42:{g}:{r}:{p}".encode()).hexdigest()[:8], 16) % len(kept)] for p in range(len(kept))]
            means.append(sum(v * w for _, v, w in drawn) / sum(w for _, _, w in drawn))
        assert np.allclose(got[g], np.quantile(means, [0.025, 0.975]))


def test_poisson_draws_are_those_of_the_expression(spark):
    df = spark.range(-40, 3000).withColumn("r", F.explode(F.array(*(F.lit(i) for i in range(5)))))
    u = F.pmod(F.xxhash64(F.lit(42), F.lit(7).cast("bigint"), "r", "id"), F.lit(1 << 40))
    want = np.zeros((5, 3040), int)
    for r in df.select("id", "r", u.alias("u")).collect():
        want[r["r"], r["id"] + 40] = np.searchsorted(draws.EDGES, r["u"], "right")
    seed = spark.range(1).select(F.xxhash64(F.lit(42), F.lit(7).cast("bigint"))).first()[0]
    got = draws.poisson_times(draws.xx_int(np.arange(5), seed & draws.LONG), np.arange(-40, 3000))
    assert (got == want).all()


def test_poisson_bootstrap_sums_before_rows(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), "id", F.lit(0.5).alias("v"), F.lit(1.0).alias("w"))
    found = sg.poisson_bootstrap(df, "g", "v", "w", "id", resamples=20)
    assert "sequence(" not in plan(found) and "MapInArrow" in plan(found)
    assert found.first()["ci_low"] == 0.5


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_documents_are_counted_where_they_are(spark, sf, monkeypatch):
    monkeypatch.setattr(vectors, "LOT", 500)
    docs, n, terms = registry.document_terms(spark, sf)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], docs.schema))
    tf = vectors.term_frequencies(docs, "doc_id", terms, "word")
    words = vectors.vocabulary_of(docs, terms, 2, 300)
    assert rows_of(words, "term", "df", "total") == rows_of(vectors.vocabulary(tf, 2, 300), "term", "df", "total")
    weights = vectors.tfidf_of(docs, "doc_id", terms, words, n)
    columns = ("id", "space", "term", "tf", "df", "weight")
    assert "Window" not in plan(weights) and "Aggregate" not in plan(weights)
    assert rows_of(weights, *columns) == rows_of(vectors.tfidf(tf, n, 2, 300), *columns)
    assert vectors.density_of(words, n).first() == vectors.density(weights, n).first()
    assert vectors.density_of(words.limit(0), n).first()["nnz"] == 0


def test_hashed_counts_deal_nothing_out(spark, sf):
    docs, _ = registry.documents(spark, sf)
    found = vectors.hashed_counts(docs, "doc_id", "text")
    assert "Window" not in plan(found) and "Aggregate" not in plan(found)
    each = docs.select("doc_id", F.explode(vectors.word_terms(F.col("text"))).alias("t")).groupBy("doc_id", F.pmod(F.xxhash64("t"), F.lit(1 << 18)).alias("bucket")).agg(F.count("*").alias("n"))
    assert rows_of(found, "id", "bucket", "n") == rows_of(each, "doc_id", "bucket", "n")
    assert all(abs(r[0] - 1) < 1e-9 for r in found.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight"))).select("sum((weight * weight))").collect())


def test_signatures_deal_nothing_out(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"]), (4, None), (5, [f"s{i}" for i in range(300)])], "id long, s array<string>")
    found = dedup.signatures(rows, "id", "s", 5)
    assert "Aggregate" not in plan(found) and "explode" not in plan(found)
    hashes = rows.select("id", F.explode("s").alias("s")).select("id", dedup.fast_hash(F.col("s")).alias("h")).collect()
    want = {i: [min((r["h"] * a + b) % dedup.PRIME for r in hashes if r["id"] == i) for a, b in dedup.permutation_seeds(5)] for i in (1, 3, 5)}
    assert {r["id"]: r["signature"] for r in found.collect()} == want
    edge = np.array([0, dedup.PRIME - 1, 1], np.uint64)
    assert dedup._least_of(edge, np.array([0, 1, 2]), [(1, 1), (dedup.PRIME - 1, 0)]).tolist() == [[1, 0], [0, 1], [2, dedup.PRIME - 1]]


def test_copies_are_one_node_of_similar_pairs(spark):
    base = [f"w{i}" for i in range(12)]
    texts = [" ".join(base)] * 4 + [" ".join(base[:10])] * 3 + ["", "other words here now"] + [" ".join(base[::-1])] * 2 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = dedup.similar_pairs(df, "id", "t", 0.5)
    assert "array_distinct" not in plan(found)  # the texts are taken apart once

    def sets(t):
        w = (t or "").split()
        return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {" ".join(w)}

    s = [sets(t) for t in texts]
    want = sorted((a, b, round(x, 9)) for b in range(len(s)) for a in range(b) if (x := len(s[a] & s[b]) / len(s[a] | s[b])) >= 0.5)
    assert rows_of(found, "a", "b", "similarity") == want and len(want) > 20
