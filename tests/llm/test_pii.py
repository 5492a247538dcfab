import re

import odd

from tideglass.llm import pii
from pyspark.sql import functions as F

# the base patterns as they are stated, for Python's engine
FORMS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, form) in enumerate(FORMS) for m in re.finditer(form, text) if fits(kind, m.group()))


TRICKY = [
    "a@b.c+d@e.f x@y z..@q-.r.s @@a@b.co", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 9.9.9", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4984250489669609", "+1 (988) 555-2485 +12 +1...........5 ++442071234567 +1(2)3",
    "é 😀 a@b.de 5.5.5.5 ü +49 30 1234567 4111111111111111", "7" * 30_000, "1 " * 20_000, "", None, "12345678901234567890 4111111111111111 1234-5678 9012-3456", "mail@x.y\nmail@x.z\t8.8.8.8",
]


def test_base_spans_like_python(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "i int, t string").select("i", pii.base_spans(F.coalesce("t", F.lit(""))).alias("s"))
    for r in df.collect():
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["s"]] == base(TRICKY[r["i"]] or ""), r["i"]


def test_table_like_python(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.find_pii(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["rank"] < 4] == base(texts[r["doc_id"]])


def planted():
    rows = []
    for i in range(30):
        rows.append((i, f"hello there kontakt: user{i}@mail.org thanks and the end"))
    rows += [(100 + i, f"dear all kontakt: member-{7000 + i} thanks for the note") for i in range(3)]
    rows += [(200 + i, f"the year {1900 + i} and the number {5000 + i} of them") for i in range(40)]
    return rows


def test_unseen_identifiers_are_found(spark):
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(odd.documents(spark, planted())).collect()}
    texts = dict(planted())
    for i in range(3):
        (s,) = [s for s in rows[100 + i] if s["kind"] == "id"]
        assert texts[100 + i][s["start"] : s["end"]] == f"member-{7000 + i}"
    assert not any(s["kind"] == "id" for i in range(40) for s in rows[200 + i])


def shape(value):
    return re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "9", value))


def plain_spans(text):
    """(state, value, left, right) of seeds, failed forms and candidates, in plain Python."""
    found, taken = [], []
    for kind, form in FORMS:
        at, hits = 0, []
        for m in re.finditer(form, text):
            hits.append((text[at : m.start()], m))
            at = m.end()
        for i, (gap, m) in enumerate(hits):
            after = hits[i + 1][0] if i + 1 < len(hits) else text[m.end() :]
            near = {"email": True, "ip": True, "card": 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19, "phone": fits("phone", m.group())}[kind]
            if near:
                taken.append(m.span())
                found.append((1 if fits(kind, m.group()) else -1, m.group(), gap, after, m.span()))
    good = [s for state, *_, s in found if state == 1]
    found = [f for f in found if f[0] == 1 or not any(a < f[4][1] and f[4][0] < b for a, b in good)]
    hits, at = [], 0
    for m in re.finditer(r"(?<!\S)(?:[+(]*[0-9][0-9().+/-]*(?:\x20[(]?[0-9][0-9().+/-]*)+(?=[\s,;:!?]|$)|[^\s0-9]*[0-9]\S*)", text):
        hits.append((text[at : m.start()], m))
        at = m.end()
    for i, (gap, m) in enumerate(hits):
        value = m.group().rstrip(pii.AFTER)
        start, end = m.start() + len(value) - len(value.lstrip(pii.BEFORE)), m.start() + len(value)
        after = hits[i + 1][0] if i + 1 < len(hits) else text[m.end() :]
        if end - start >= pii.SHORTEST_VALUE and not any(a < end and start < b for a, b in taken):
            found.append((0, value.lstrip(pii.BEFORE), gap, after, (start, end)))
    word = lambda t, i: (t.split() or [""])[i].lower()
    return [(state, value, word(gap, -1), word(after, 0)) for state, value, gap, after, _ in found]


def brute(texts):
    """{value: score} of discovered values."""
    edges, states = {}, {}
    for t in texts:
        for state, v, left, right in plain_spans(t):
            for p in {"<" + left, ">" + right, "=" + shape(v), left and f"<{left} ={shape(v)}"} - {"", "<", ">"}:
                edges[(p, v)] = edges.get((p, v), 0) + 1
                states.setdefault(v, set()).add(state)
    support = {p: len({v for q, v in edges if q == p and 1 in states[v]}) for p, _ in edges}
    edges = {(p, v): n for (p, v), n in edges.items() if support[p] >= pii.LEAST_SEEDS}
    words = [w for t in texts for w in t.lower().split()]
    occurs = {p: max(words.count(p[1:]) if " " not in p and p[0] != "=" else 0, sum(n for (q, _), n in edges.items() if q == p)) for p, _ in edges}
    score = {v: float(1 in s) for v, s in states.items()}
    for _ in range(pii.ROUNDS):
        strength = {p: sum(score[v] * n for (q, v), n in edges.items() if q == p) / (occurs[p] + pii.SMOOTH) for p in occurs}
        for v, s in states.items():
            miss = 1.0
            for p, w in edges:
                if w == v:
                    miss *= 1 - min(strength[p], 0.999999)
            score[v] = 1.0 if 1 in s else 0.0 if -1 in s else 1 - miss
    return {v: x for v, x in score.items() if states[v] == {0} and x >= pii.LEAST}


def test_scores_like_brute_force(spark):
    rows = planted() + [(300 + i, f"pay 49842504896696{10 + i} or 1.2.3.{250 + i}, ref (AB-12{i}) tel (766) 555-23{70 + i}. End") for i in range(12)]
    rows += [(400 + i, f"pay {v} now") for i, v in enumerate(("4111111111111111", "4984250489669609", "5500005555555559", "6011000990139424"))]
    docs = odd.documents(spark, rows)
    found = {r["value"]: r["score"] for r in pii.bootstrap(docs, pii.scan(docs, "doc_id", "text")).collect()}
    want = brute([t for _, t in rows])
    assert found.keys() == want.keys() and want and all(abs(found[v] - want[v]) < 1e-9 for v in want)


def test_failing_cards_are_not_found(spark):
    """Sixteen digits that fail Luhn's check beside many that pass it."""
    good = [f"{p:015d}" for p in range(4_111_111_111_111_00, 4_111_111_111_111_40)]
    good = [g + next(d for d in "0123456789" if luhn(g + d)) for g in good]
    bad = good[0][:-1] + ("1" if good[0][-1] != "1" else "2")
    docs = odd.documents(spark, [(i, f"card {g} paid") for i, g in enumerate([*good, bad])])
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert rows[len(good)] == [] and all(len(rows[i]) == 1 for i in range(len(good)))


def test_hidden_seeds_come_back(spark):
    """A third of the e-mails and phones of the smallest tables' kind, in random prose, without telling contexts."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = odd.prose(rng, 40).split()
        words[rng.randrange(40)] = f"{words[0]}.{rng.randrange(10, 99)}@mail{rng.randrange(9)}.example.com" if i % 2 else f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        words[rng.randrange(40)] += f" {rng.randrange(1900, 2030)}"
        rows.append((i, " ".join(words)))
    got = {r["kind"]: r for r in pii.recovery(odd.documents(spark, rows)).collect()}
    hidden, back = sum(r["hidden"] for r in got.values()), sum(r["back"] for r in got.values())
    assert hidden > 60 and back / hidden > 0.95 and back / got["id"]["found"] > 0.95


def test_long_words_and_values(spark):
    long = "k" * 300 + ":"
    rows = [(i, f"see {long} u{i}@mail.org {'z' * 200} end") for i in range(40)] + [(99, f"see {long} {'7x' * 200} {'z' * 200} end")]
    (s,) = {r["doc_id"]: r["spans"] for r in pii.find_pii(odd.documents(spark, rows)).collect()}[99]
    assert s["kind"] == "id" and s["value"] == "7x" * 200


def test_places_of_many_matches(spark):
    """More matches than are summed one after the other."""
    from tideglass.llm import spans

    text = " ".join(f"é{'x' * (i % 7)}{i}" for i in range(3000))
    for around in (0, 3, None):
        (r,) = spark.createDataFrame([(text,)], "t string").select(spans.matches(F.col("t"), "[0-9]+", around).alias("m")).collect()
        assert [(m["start"], m["end"], m["value"]) for m in r["m"]] == [(*m.span(), m.group()) for m in re.finditer("[0-9]+", text)]
        gaps = re.split("[0-9]+", text)
        assert [m["before"] for m in r["m"]] == [g if around is None else g[-around:] if around else "" for g in gaps[:-1]]
        assert [m["after"] for m in r["m"]] == [g if around is None else g[:around] if around else "" for g in gaps[1:]]


def test_odd_rows(spark):
    rows = pii.find_pii(odd.odd_documents(spark)).collect()
    assert len(rows) == len(odd.texts()) and all(r["spans"] == [] for r in rows)
    assert pii.find_pii(odd.empty_documents(spark)).count() == 0


def test_many_patterns_hide_no_other(spark):
    """4,200 patterns of four seeds do not keep one of three seeds from its identifier."""
    name = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(100 * j + part, " ".join(f"{name(i)} u{i}x{j}@mail.org" for i in range(100 * part, 100 * part + 100)) + f" {name(100 * part + 100)}") for j in range(4) for part in range(21)]
    rows += [(1000 + i, f"kontakt: user{i}@mail.org danke") for i in range(3)] + [(2000, "kontakt: member-7000 danke")]
    docs = odd.documents(spark, rows)
    assert [r["value"] for r in pii.bootstrap(docs, pii.scan(docs, "doc_id", "text")).collect()] == ["member-7000"]
