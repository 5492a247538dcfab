import random

import numpy as np
import odd
import pytest

from tideglass.llm import dart_minhash as dm


def similar(a, b):
    h = dm.WordHashes()
    return dm.similarity(dm.shingles(dm.words_of(a), h), dm.shingles(dm.words_of(b), h))


def brute(rows):
    """class id of every row by comparing each with each."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    ids = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(rows[i][0], ids[root(i)]) for i in range(len(rows))]


def order(x):
    return tuple(-1 if v is None else v for v in x)


def classes(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in dm.near_duplicate_classes(df).collect()), key=order)


def test_weighted_similarity_is_estimated():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.2, 3, 200), rng.uniform(0.2, 3, 200)
    a, b = dict(zip(elements[:200].tolist(), wa)), dict(zip(elements[100:].tolist(), wb))
    keys = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    s = dm.weighted_signatures(np.concatenate([elements[:200], elements[100:]]), np.concatenate([wa, wb]), np.repeat([0, 1], 200), 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.03)


def test_signature_does_not_depend_on_company():
    rng = random.Random(2)
    texts = [odd.prose(rng, n) for n in (0, 1, 4, 5, 60, 3000)]
    together = dm.text_bands(texts, dm.WordHashes(), 24, 5)
    for i, t in enumerate(texts):
        alone = dm.text_bands([t], dm.WordHashes(), 24, 5)
        assert (alone[0] == together[i]).all()


def test_odd_rows(spark):
    assert classes(odd.odd_documents(spark)) == sorted(brute([r[:2] for r in odd.texts()]), key=order)
    assert dm.near_duplicate_classes(odd.empty_documents(spark)).count() == 0


@pytest.mark.parametrize(("lot", "block"), [(4096, 4096), (3, 7)])
def test_families_like_brute_force(spark, monkeypatch, lot, block):
    monkeypatch.setattr(dm, "LOT", lot)
    monkeypatch.setattr(dm, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    for family in range(4):
        base = odd.prose(rng, 90).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, odd.prose(rng, 40)) for i in range(20)]
    rng.shuffle(rows)
    assert classes(odd.documents(spark, rows)) == sorted(brute(rows))


def test_one_bucket_of_many_members(spark, monkeypatch):
    """5,000 different texts in one bucket: six blocks meet, and the planted pairs are found, no others."""
    monkeypatch.setattr(dm, "BLOCK", 900)
    monkeypatch.setattr(dm, "text_buckets", lambda texts, hashes, bands, rows, size: [np.array([7], np.int64)] * len(texts))
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(12))) for i in range(5_000)]
    pairs = {i: 4_999 - i for i in range(30)}
    for i, j in pairs.items():
        words = rows[i][1].split() * 4
        rows[i], rows[j] = (i, " ".join(words)), (j, " ".join([*words, "end"]))
    found = dm.near_duplicate_classes(odd.documents(spark, rows)).where("doc_id != class_id").collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {j: i for i, j in pairs.items()}


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = odd.odd_documents(spark).withColumn("at", F.lit("mine")).withColumn("lot", F.lit(1)).withColumn("id", F.lit("x"))
    out = dm.drop_near_duplicates(docs)
    assert out.columns == docs.columns and {r["at"] for r in out.collect()} == {"mine"}


def test_table_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert classes(docs) == sorted(brute(rows))


def test_one_of_each_class_stays(spark):
    docs = odd.odd_documents(spark)
    stay = dm.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    want = {c for _, c in brute([r[:2] for r in odd.texts()])}
    rows = stay.collect()
    assert len(rows) == len(want) or len(rows) == len({(c, i is None) for i, c in brute([r[:2] for r in odd.texts()])})
    assert {r["doc_id"] for r in rows} == want
    assert dm.drop_near_duplicates(odd.empty_documents(spark)).count() == 0


def test_packed_sketches_count_differences():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, (2, 960)).astype(np.uint64)
    b[::3] = a[::3]
    x, y = (dm.packed(v[None]).view(np.uint64) for v in (a, b))
    want = (((a >> np.uint64(40)) & np.uint64(15)) != ((b >> np.uint64(40)) & np.uint64(15))).sum()
    assert dm.differing(x, y).tolist() == [want]
    many = np.concatenate([x, y, x])
    assert [v.tolist() for v in dm.agreeing(many, x, 0.8)] == [[0, 2], [0, 0]]


def test_plain_copies_with_a_repeated_passage(spark):
    """Texts whose sets agree are one class, however often one of them repeats a passage."""
    rng = random.Random(8)
    rows = []
    for i in range(20):
        words = [f"x{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[-10:] * 60))]
    assert {r["doc_id"]: r["class_id"] for r in dm.near_duplicate_classes(odd.documents(spark, rows)).collect()} == {i: i - i % 2 for i in range(40)}


def test_plain_copies_in_a_split_bucket(spark):
    """Bands and sketches see a plain pair, also where neither text is its bucket's centre."""
    words = [f"x{i}" for i in range(300)]
    a, b = " ".join(words), " ".join(words + words[-10:] * 20)
    hashes = dm.WordHashes()
    (_, weighted, repeats, plain) = next(dm.both_signatures([a, b], hashes, dm.SKETCH))
    agree = dm.least_agreement(dm.THRESHOLD, dm.SKETCH)
    assert repeats.tolist() == [1] and (weighted[0] == weighted[1]).sum() < agree <= (weighted[0] == plain[0]).sum()
    one, two = dm.text_buckets([a, b], hashes, dm.BANDS, dm.ROWS)
    assert len(one) == dm.BANDS and len(set(one) & set(two)) > dm.BANDS // 2
