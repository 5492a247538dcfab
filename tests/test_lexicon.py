import re

import pytest

from tideglass.functions import lexicon as lx
from tideglass.functions.text import abbreviated_count
from pyspark.sql import functions as F

CASES = [
    ("nifty 24500 CE loaded", 0.725, 2, False),
    ("banknifty 52000 PE loaded", -0.725, 2, False),
    ("is not bullish here", -0.9, 1, False),
    ("strong short covering", 0.675, 2, False),
    ("23900 will come #CRASH", 0.0, 0, False),
    ("🚀🚀🚀🚀🚀", 0.9, 3, False),
    ("spot 24530, expiry tomorrow", 0.0, 0, False),
    ("join my telegram for breakout", 0.8, 1, True),
    ("", 0.0, 0, False),
    ("not at all a day to be bullish", 0.9, 1, False),
    ("nifty https://x.org/#bullish @bullish crash", -0.9, 1, False),
    ("#निफ्टी तेज 📈", 0.8, 1, False),
    ("undershorted longish", 0.0, 0, False),
]


def twin(text):
    """The same score, one text at a time."""
    body = re.sub(r"@\w+", " ", re.sub(r"https?://\S+", " ", re.sub(r"[#＃]\w+", " ", text)))
    low, found = body.lower(), []
    for m in re.finditer(r"(?<!\w)(" + "|".join(map(re.escape, lx.LONGEST_FIRST)) + r")(?!\w)", low):
        before = low[: m.start()].split()[-3:]
        found.append(lx.LEXICON[m.group()] * (-1 if any(t.strip(".,!?") in lx.NEGATIONS for t in before) else 1))
    for e, w in lx.EMOJI.items():
        found += [w] * min(body.count(e), 3)
    found += [0.6 if x.lower() == "ce" else -0.6 for _, x in re.findall(r"(?i)\b(\d{4,6})\s*(ce|pe)\b", body)]
    return (sum(found) / len(found) if found else 0.0), len(found)


def test_cases(spark):
    df = lx.add_score(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, content string"))
    for r in df.collect():
        _, polarity, evidence, promo = CASES[r["i"]]
        assert r["polarity"] == pytest.approx(polarity, abs=1e-9) and r["evidence"] == evidence and r["is_promo"] == promo, CASES[r["i"]]


def test_twin_on_odd_texts(spark):
    texts = [c[0] for c in CASES] + ["no! sell off, not. breakout", "52 week high 52 week low", "न 24500ce ⬆️ ❤️❤️❤️❤️ not strong", "long-long longs, long", "buy\tce buy\nce loaded never , . hold"]
    rows = lx.add_score(spark.createDataFrame([(t,) for t in texts], "content string")).collect()
    for r in rows:
        polarity, evidence = twin(r["content"])
        assert (r["evidence"], r["polarity"]) == (evidence, pytest.approx(polarity, abs=1e-9)), r["content"]


def test_sizes_of_the_tables():
    assert len(lx.LEXICON) == 129 and len(lx.EMOJI) == 18 and len(lx.NEGATIONS) == 11


def test_classes(spark):
    rows = [("sebi on margin", "earnings"), ("dividend and vix", "corporate_action"), ("max pain", "mechanical"), ("Q3FY25 soon", "earnings"), ("patience", "discussion")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", lx.content_class(F.col("t")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_abbreviated_counts(spark):
    rows = [("1.2K", 1200), ("1,234", 1234), ("3M", 3000000), ("1.2.3", 0), ("x", 0), (None, 0), ("", 0)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("got", abbreviated_count(F.col("t")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_every_term_with_negations_near_and_far(spark):
    """Each of the terms, alone, negated at distances one to four, twice in a row, and in one long post."""
    texts = []
    for t in lx.LEXICON:
        texts += [f"x {t} y", f"not {t}", f"never a {t}", f"don't a b {t}!", f"no a b c {t}", f"{t} {t}", f"nahi {t.upper()}"]
    texts.append(" and not ".join(list(lx.LEXICON) * 20))
    rows = lx.add_score(spark.createDataFrame([(t,) for t in texts], "content string")).collect()
    for r in rows:
        polarity, evidence = twin(r["content"])
        assert (r["evidence"], r["polarity"]) == (evidence, pytest.approx(polarity, abs=1e-9)), r["content"][:80]
