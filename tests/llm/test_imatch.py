import hashlib
import math
import re

import numpy as np
import odd
import xxhash

from tideglass.llm import imatch

MASK = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def h64(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def chain(values):
    """Spark's xxhash64 of an array of longs: each hashed with the hash so far as seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(int(v & MASK).to_bytes(8, "little"), seed=h)
    return signed(h)


def terms(text):
    return set(re.split(r"[\s!-/:-@\[-`{-~]+", text.lower())) - {""}


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    ts = [t or "" for _, t in rows]
    df = {}
    for t in ts:
        for w in terms(t):
            df[h64(w) % imatch.SLOTS] = df.get(h64(w) % imatch.SLOTS, 0) + 1
    n = len(ts)
    lexicon = {s for s, c in df.items() if imatch.SELDOM * n <= c <= imatch.OFTEN * n}

    def parts(t):
        every = terms(t)
        kept = sorted(w for w in every if h64(w) % imatch.SLOTS in lexicon) or sorted(every)
        hs = [h64(w) for w in kept]
        out = []
        for low, bits, subsets in imatch.TIERS:
            for k in range(subsets):
                mine = [h for h in hs if ((h & MASK) >> low) % (1 << bits) == k]
                out.append(chain(mine) if mine else None)
        return chain(hs), out

    def like(a, b):
        used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in used) / len(used) if used else 1.0

    found = []
    for i, t in enumerate(ts):
        nxt = ts[(i + 1) % n]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        whole, mine = parts(t)
        found.append((rows[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{whole & MASK:016x}", like(mine, parts(edited)[1]), like(mine, parts(nxt)[1])))
    return found


def result(df):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"][:16], r["near_edited"], r["near_next"]) for r in df.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[3])


def same(got, want):
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for group_rows in (1024, 7):
        same(result(imatch.fingerprint_pairs(docs, group_rows=group_rows)), brute(rows))


def test_odd_rows(spark):
    same(result(imatch.fingerprint_pairs(odd.odd_documents(spark), group_rows=4)), brute([r[:2] for r in odd.texts()]))


def test_one_row_and_none(spark):
    (r,) = imatch.fingerprint_pairs(odd.documents(spark, [(1, "a few words here")])).collect()
    assert r["near_next"] == 1.0 and not math.isnan(r["near_edited"])
    assert imatch.fingerprint_pairs(odd.empty_documents(spark)).count() == 0


def test_equal_texts_equal_prints(spark):
    rows = imatch.fingerprints(odd.odd_documents(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
