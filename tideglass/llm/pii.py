"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base kinds are found by four fixed patterns with checks. They are the seeds. Candidates for unseen
identifiers are other tokens, or runs of numbers, with a digit. What fails the check of a base form (a
card's digits, an address' parts) is known not to be one: it counts against its patterns and is never
found. Four lexical patterns come with each instance: the word before it, the word after it, its shape
(digits as 9, runs of letters as a), and the word before together with the shape. Patterns and instances
form a graph, and scores go round it ROUNDS times:

* a pattern's score is the mass of its instances' scores over all its occurrences in the corpus, with
  SMOOTH occurrences added: for words, every place where the word stands, so a common word that happens
  to stand before some seeds scores near zero; for shapes, every span with a digit of that shape;
* an instance's score is one minus the product of (1 - score) over its patterns; seeds stay at one.

Instances of at least LEAST score through patterns that LEAST_SEEDS different seeds support become
spans of kind `id`, in every text where they stand. All such patterns count, however many there are:
their graph and their words meet the texts by joins on the word, of counts that each task has summed
before, with frequent keys dealt to SALTS tasks. Counts of occurrences cover the whole corpus. Words,
shapes and values of any length count; long ones travel as their digests.

`recovery` hides a share of the seeds from the method and counts how many of them come back.

Defined results: null or empty text has no spans; rows repeat and ids may be null, each row has its
own result; a span of a base kind is never replaced, and no `id` span overlaps one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import cut
from tideglass.llm.spans import matches_where

# The base patterns. Possessive forms match the same texts without backtracking.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Numbers side by side, else one token with a digit.
CANDIDATE = r"(?<!\S)(?:[+(]*+[0-9][0-9().+/-]*+(?:\x20[(]?[0-9][0-9().+/-]*+)++(?=[\s,;:!?]|$)|[^\s0-9]*+[0-9]\S*+)"
BEFORE, AFTER = "(\"'[<{", ".,;:!?)\"']>}"  # what is no part of a candidate at its ends
SHORTEST_VALUE, LONG = 4, 64  # code points of a candidate; of a key that travels as it is

ROUNDS, SMOOTH, LEAST, LEAST_SEEDS = 3, 5.0, 0.5, 3
SALTS = 32  # parts into which the edges of one pattern are dealt


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def byte_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(999)) <= 255)


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), byte_part)
    if kind == "card":
        # Luhn's check is asked for only where the length is right
        return F.length(digits(value)).between(14, 19) & F.when(F.length(digits(value)).between(14, 19), F.call_function("luhn_check", digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def blanks(text: Column) -> Column:
    return F.translate(text, "\t\n\r\f\x0b", "     ")


def last_word(text: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(blanks(text)), " ", -1))


def first_word(text: Column) -> Column:
    return F.lower(F.substring_index(F.ltrim(blanks(text)), " ", 1))


def key_of(text: Column) -> Column:
    """The text, or a digest of a long one."""
    return F.when(F.length(text) <= LONG, text).otherwise(F.concat(F.lit("#"), F.md5(text)))


def shape_of(value: Column) -> Column:
    return key_of(F.regexp_replace(F.translate(value, "012345678", "999999999"), r"\p{L}+", "a"))


def forms(text: Column) -> Column:
    """array<struct<start,rank,end,kind,value,left,right,ok>> of the base kinds (ok) and of what has a card's
    or an address' form and fails its check, sorted by start, then kind."""
    asks = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        "card": F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")),
        "phone": F.contains(text, F.lit("+")),
    }
    found = []
    for rank, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        found.append(typed(matches_where(asks[kind], text, pattern, None), kind, rank))
    return F.sort_array(F.concat(*found))


def base_spans(text: Column) -> Column:
    return F.filter(forms(text), lambda s: s["ok"])


def typed(hits: Column, kind: str, rank: int) -> Column:
    def row(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), last_word(m["before"]).alias("left"), first_word(m["after"]).alias("right"), passes(kind, m["value"]).alias("ok"))

    def counts(m: Column) -> Column:
        if kind == "card":
            return F.length(digits(m["value"])).between(14, 19)
        return passes(kind, m["value"]) if kind == "phone" else F.lit(True)

    return F.transform(F.filter(hits, counts), row)


def candidates(text: Column, forms: Column) -> Column:
    """array<struct<start,end,value,left,right>> of candidates that meet no hit of a base form."""
    hits = matches_where(F.rlike(text, F.lit("[0-9]")), text, CANDIDATE, None)

    def row(m: Column) -> Column:
        value = F.rtrim(m["value"], F.lit(AFTER))
        start = m["start"] + F.length(value) - F.length(F.ltrim(value, F.lit(BEFORE)))
        return F.struct(start.alias("start"), (m["start"] + F.length(value)).alias("end"), F.ltrim(value, F.lit(BEFORE)).alias("value"), last_word(m["before"]).alias("left"), first_word(m["after"]).alias("right"))

    def free(m: Column) -> Column:
        return (F.length(m["value"]) >= SHORTEST_VALUE) & F.rlike(m["value"], F.lit("[0-9]")) & ~F.exists(forms, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    return F.filter(F.transform(hits, row), free)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base spans, failed hits of base forms and candidates of every text; no text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    source = source.withColumn("forms", forms(F.col("text")))
    source = source.select("row", "doc_id", "forms", F.filter("forms", lambda s: s["ok"]).alias("base"), candidates(F.col("text"), F.col("forms")).alias("cands"))
    # a hit that fails within a span of another kind says nothing
    failed = F.filter("forms", lambda s: ~s["ok"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return source.select("row", "doc_id", "base", failed.alias("failed"), "cands")


def scan_hidden(scanned: DataFrame, share: float) -> DataFrame:
    """The scan with a share of the seeds' values among the candidates."""
    shown = F.filter("base", lambda s: ~hidden_value(share, s["value"]))
    back = F.transform(F.filter("base", lambda s: hidden_value(share, s["value"])), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "value", "left", "right"))))
    return scanned.select("row", "doc_id", shown.alias("base"), "failed", F.concat("cands", back).alias("cands"))


def hidden_value(share: float, value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1000)) < int(share * 1000)


def pattern_edges(found: Column) -> Column:
    """The patterns of a span: the word before it, the word after it, its shape, and the first with the last."""
    left, right, shape = F.concat(F.lit("<"), key_of(found["left"])), F.concat(F.lit(">"), key_of(found["right"])), F.concat(F.lit("="), shape_of(found["value"]))
    return F.filter(F.array(left, right, shape, F.when(F.length(left) > 1, F.concat(left, F.lit(" "), shape))), lambda p: F.length(p) > 1)


def edges_of(scanned: DataFrame) -> DataFrame:
    """pattern, value, state (1: seed, 0: candidate, -1: fails its check), n: how often each value stands in each pattern."""
    sides = []
    for column, state in (("base", 1), ("cands", 0), ("failed", -1)):
        one = scanned.select(F.explode(column).alias("s")).select(F.explode(pattern_edges(F.col("s"))).alias("pattern"), key_of(F.col("s.value")).alias("value"))
        sides.append(one.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit(state)))
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def occurrences(docs: DataFrame, text_col: str, edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, occurs: how often its word stands in the corpus; where it has a shape, how often spans meet it."""
    by_word = F.rlike("pattern", F.lit("^[<>]\\S*$"))
    words = patterns.where(by_word).select(F.expr("substring(pattern, 2)").alias("word")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.explode(F.split(F.lower(blanks(text)), " +")).alias("word")).where("word != ''")
    # summed per task before the shuffle and joined after it, so a word is one row however often it stands
    counted = every.groupBy(key_of(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("occurs")).join(words, "word")
    spans = edges.groupBy("pattern").agg(F.sum("n").alias("spans"))
    of = patterns.join(spans, "pattern", "left").withColumn("word", F.when(by_word, F.expr("substring(pattern, 2)")))
    return of.join(counted, "word", "left").select("pattern", F.greatest(F.coalesce("occurs", F.lit(0)), "spans").alias("occurs"))


def salted(many: DataFrame, of: DataFrame, key: str, by: str) -> DataFrame:
    """Joined on `key`; of each key in `of` there is one row, and a frequent key's rows go to SALTS tasks by `by`."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    every = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # never broadcast: the estimate of its size knows nothing of the salts
    return dealt.join(every.hint("merge"), [key, "salt"]).drop("salt")


def bootstrap(docs: DataFrame, scanned: DataFrame, text_col: str = "text", rounds: int = ROUNDS, least: float = LEAST, smooth: float = SMOOTH, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """value, score of the discovered identifiers; a long value as its key."""
    edges = cut(edges_of(scanned), "pii-edges")
    support = edges.where("state = 1").groupBy("pattern").agg(F.count_distinct("value").alias("seeds")).where(F.col("seeds") >= least_seeds)
    weight = cut(occurrences(docs, text_col, edges, support.select("pattern")), "pii-patterns")
    graph = cut(salted(edges, weight, "pattern", "value"), "pii-graph")
    score = graph.select("pattern", "value", (F.col("state") == 1).cast("double").alias("score"), "n", "state", "occurs")
    found = None
    for i in range(rounds):
        by_pattern = score.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / (F.max("occurs") + smooth)).alias("p"))
        linked = salted(graph, by_pattern, "pattern", "value")
        miss = F.sum(F.log1p(-F.least("p", F.lit(0.999999))))
        known, bad = F.max("state") == 1, F.min("state") == -1
        found = linked.groupBy("value").agg(F.when(known, 1.0).when(bad, 0.0).otherwise(1 - F.exp(miss)).alias("score"), (known | bad).alias("known"))
        if i + 1 < rounds:
            found = cut(found, "pii-scores")
            score = salted(graph, found.select("value", "score"), "value", "pattern")
    return found.where(~F.col("known") & (F.col("score") >= least)).select("value", "score")


def recovery(docs: DataFrame, share: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """kind, hidden, back, found: with a share of the seeds' values hidden from the method, how many different
    ones it had to find, how many came back, and (kind `id`) how many values it found in all."""
    scanned = cut(scan(docs, id_col, text_col), "pii-scan")
    masked = cut(scan_hidden(scanned, share), "pii-masked")
    found = cut(bootstrap(docs, masked, text_col, **options), "pii-found")
    values = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct().where(hidden_value(share, F.col("value")))
    hit = values.select("kind", key_of(F.col("value")).alias("value")).join(found.select("value", F.lit(1).alias("hit")), "value", "left")
    by_kind = hit.groupBy("kind").agg(F.count(F.lit(1)).alias("hidden"), F.count("hit").alias("back"), F.count("hit").alias("found"))
    return by_kind.unionByName(found.agg(F.lit("id").alias("kind"), F.lit(0).cast("bigint").alias("hidden"), F.lit(0).cast("bigint").alias("back"), F.count(F.lit(1)).alias("found")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and spans: array<struct<start,rank,end,kind,value>> of base kinds (rank 0 to 3) and `id` (4)."""
    scanned = cut(scan(docs, id_col, text_col), "pii-scan")
    new = bootstrap(docs, scanned, text_col, **options).withColumnRenamed("value", "key")
    hits = scanned.where(F.size("cands") > 0).select("row", F.explode("cands").alias("c")).select("row", "c.*", key_of(F.col("c.value")).alias("key"))
    hits = salted(hits, new, "key", "row")
    extra = hits.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("id").alias("kind"), "value")).alias("extra"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    joined = scanned.select("row", "doc_id", base.alias("base")).join(extra, "row", "left")
    return joined.select("doc_id", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra"))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
