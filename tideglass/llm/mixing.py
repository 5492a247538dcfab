"""Soft-membership mixing of a corpus to target weights, in DataFrame functions only.

A labelled table gives some documents a domain. A naive Bayes classifier predicts for every document the
posterior of each domain: from its words, hashed to BUCKETS, and from bins of FEATURES of its surface,
both counted in SQL. The words' weights count in units of UNIT, those of two domains in the halves of one
integer, so that a text's words are gone through once for two domains, and sums are exact. It learns from at most LABELLED labelled rows (the bound of the fit); one in FOLDS
of them is held out and chooses how far the words' evidence counts: it grows with a power of the number of
words, as words of one text are not independent. The same rows give the classifier's held-out accuracy
and loss. What it sends to workers is bounded by BUCKETS numbers per domain.

Nonnegative rates r of documents, `most` at most, are then fitted by projected gradient least squares, so
that the expected tokens of each domain, sum of r * tokens * posterior, match the target: each step
aggregates the domains' totals over all documents, moves every rate along the gradient (per token, and
scaled by the Gram matrix of the free documents), and projects it. All starts at rate 1, so tokens keep as
close to it as the targets allow. What a step broadcasts is one number per domain, and a document's rate
is a closed expression of its own posteriors. The report tells each domain's natural, target and reached
tokens, so targets that the documents cannot meet are seen.

A rate of 2.3 stands for two copies and a third with chance 0.3, decided by a hash of id and text. Texts are
read once: rows are written to the shared folder with their posteriors, and copies come from there.

Defined results: null or empty text has no tokens, rate 1 and one copy in `mix`; labels with a null
id or domain are ignored; without labels all documents stay as they are; domains whose target is
missing get 0; rows repeat and ids may be null; extra columns stay in `mix`, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import cut
from tideglass.llm.spans import let

LABELLED, BINS, BUCKETS, FOLDS = 20_000, 12, 1 << 14, 5
STEPS, CLOSE = 60, 1e-4
SMOOTH = 0.1  # added to each count of a word
UNIT, HALF = 1e-4, 1 << 31  # of the words' weights; what the sum of a half of a pair stays under
#: As classes of single characters, which Java looks up in one table: \s, and \s with \p{Punct}.
BLANK = r" \t\n\x0B\f\r"
PLAIN = BLANK + r".,;:!?'\"()\-"
MARKS = BLANK + r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]\^_`{|}~"
FEATURES = ("length", "word", "symbols", "digits", "upper", "distinct")
#: (power of the number of words, factor): how the evidence of the words may count.
TEMPERS = ((0.0, 1.0), (0.0, 0.3), (0.5, 3.0), (0.5, 1.0), (0.5, 0.3), (1.0, 30.0), (1.0, 10.0), (1.0, 3.0), (1.0, 0.0))


def add_features(df: DataFrame, text: str) -> DataFrame:
    """Adds `tokens`, `x` (doubles in the order of FEATURES) and `words` (a bucket per word)."""
    t = F.col(text)
    n = F.greatest(F.length(t), F.lit(1)).cast("double")

    def parted(value: Column, at: str, characters: str) -> Column:
        """What stands between runs of some characters; trimmed, so that no part is empty."""
        inner = F.btrim(value, F.lit(characters))
        return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{at}]+"))

    def share(pattern: str) -> Column:
        return (F.length("rest") - F.length(F.regexp_replace("rest", pattern, ""))) / n

    df = df.withColumn("tokens", F.size(parted(t, BLANK, string.whitespace)))
    df = df.withColumn("terms", parted(F.lower(t), MARKS, string.whitespace + string.punctuation))
    # most of a text is in none of the classes that are counted, and goes at once
    df = df.withColumn("rest", F.regexp_replace(t, f"[{string.ascii_lowercase}{PLAIN}]+", ""))
    count = F.greatest("tokens", F.lit(1)).cast("double")
    distinct = F.size(F.array_distinct("terms")) / F.greatest(F.size("terms"), F.lit(1)).cast("double")
    x = [F.log1p(count), n / count, share(rf"[^{PLAIN}\p{{L}}\p{{N}}]+"), share("[0123456789]+"), share(r"\p{Lu}+"), distinct]
    words = F.transform("terms", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return df.withColumn("x", F.array(*x)).withColumn("words", words).drop("terms", "rest")


@dataclass
class Classifier:
    """Naive Bayes: per domain a log prior, log probabilities per feature and bin (edges per feature), log
    weights per bucket, and the temper; held_out: rows, accuracy and loss of what was held out."""

    domains: list[str]
    priors: list[float]
    edges: list[list[float]]
    tables: list[list[list[float]]]
    weights: list[list[float]]
    temper: tuple[float, float] = (0.0, 1.0)
    held_out: tuple[int, float, float] = (0, float("nan"), float("nan"))

    def surface(self, x: Column) -> list[Column]:
        """Log prior and log probability of the bins, per domain."""
        bins = [sum((F.when(x[j] > e, 1).otherwise(0) for e in edges), F.lit(0)) for j, edges in enumerate(self.edges)]
        return [F.lit(prior) + sum((F.get(F.array(*(F.lit(v) for v in row)), bins[j]) for j, row in enumerate(table)), F.lit(0.0)) for table, prior in zip(self.tables, self.priors, strict=True)]

    def evidence(self, words: Column) -> Column:
        """array<double> of the sums of the words' weights, per domain."""
        units = [[round(v / UNIT) for v in row] for row in self.weights]
        least = min((min(row) for row in units), default=0)
        # of so many words at most the sums stay under HALF
        part = max(1, (HALF - 1) // max(1, max((max(row) for row in units), default=0) - least))
        size = F.size(words)
        starts = F.sequence(F.lit(0), F.floor((size - 1) / part).cast("int"))

        def pair(high: list[int], low: list[int]) -> Column:
            table = F.split(F.lit(",".join(str(((a - least) << 32) + b - least) for a, b in zip(high, low, strict=True))), ",").cast("array<bigint>")

            def total(some: Column) -> Column:
                return F.aggregate(some, F.lit(0).cast("bigint"), lambda s, b: s + F.get(table, b))

            def halves(sums: Column) -> Column:
                least_sum = size.cast("bigint") * least
                high = F.aggregate(sums, least_sum, lambda s, v: s + F.shiftright(v, 32))
                low = F.aggregate(sums, least_sum, lambda s, v: s + v.bitwiseAND(F.lit((1 << 32) - 1)))
                return F.array(high * UNIT, low * UNIT)

            sums = F.when(size <= part, F.array(total(words))).otherwise(F.transform(starts, lambda i: total(F.slice(words, i * part + 1, F.lit(part)))))
            return let(sums, halves)

        pairs = [pair(units[i], units[min(i + 1, len(units) - 1)]) for i in range(0, len(units), 2)]
        return F.slice(F.flatten(F.array(*pairs)), 1, len(units))

    def posteriors(self, surface: Column, evidence: Column, n_words: Column, temper: tuple[float, float] | None = None) -> Column:
        """array<double> of the domains' posteriors, from arrays of surface and evidence."""
        power, factor = temper or self.temper
        scale = F.lit(factor) / F.pow(F.greatest(n_words, F.lit(1)).cast("double"), F.lit(power))
        logs = F.zip_with(surface, evidence, lambda a, b: a + b * scale)

        def shares(raw: Column) -> Column:
            return let(F.aggregate(raw, F.lit(0.0), lambda s, q: s + q), lambda total: F.transform(raw, lambda v: v / total))

        return let(logs, lambda x: let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp(v - top)), shares)))


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, bins: int = BINS) -> Classifier | None:
    """domain: a column of `labels`; their number is expected to be small."""
    known = labels.select(F.col(id_col).alias("id"), domain.cast("string").alias("domain")).where("id is not null and domain is not null")
    known = known.groupBy("id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = add_features(source.join(F.broadcast(known), "id"), "text")
    rows = cut(rows.select("domain", "x", "words", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)) == 0).alias("held")), "mixing-labelled")
    sizes = {r["domain"]: (r["n"], r["train"]) for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("held")).alias("train")).collect()}
    if not sizes:
        return None
    domains, total = sorted(sizes), sum(n for n, _ in sizes.values())
    # a small table is learned from as a whole
    folds = min(t for _, t in sizes.values()) > 0 and any(n > t for n, t in sizes.values())
    train, held = (rows.where(~F.col("held")), rows.where("held")) if folds else (rows, rows.limit(0))
    counts = {d: t if folds else n for d, (n, t) in sizes.items()}
    found = train.agg(*(F.percentile_approx(F.col("x")[j], [k / bins for k in range(1, bins)], 2000).alias(f"e{j}") for j in range(len(FEATURES)))).first()
    edges = [sorted(set(found[j] or [])) for j in range(len(FEATURES))]
    binned = train.select("domain", F.posexplode(F.array(*(sum((F.when(F.col("x")[j] > e, 1).otherwise(0) for e in edges[j]), F.lit(0)) for j in range(len(FEATURES))))).alias("j", "b"))
    tables = [[[math.log(1.0 / (counts[d] + len(e) + 1))] * (len(e) + 1) for e in edges] for d in domains]
    for r in binned.groupBy("domain", "j", "b").count().collect():
        tables[domains.index(r["domain"])][r["j"]][r["b"]] = math.log((r["count"] + 1.0) / (counts[r["domain"]] + len(edges[r["j"]]) + 1))
    # at most BUCKETS counts per domain
    seen = [[0] * BUCKETS for _ in domains]
    for r in train.select("domain", F.explode("words").alias("w")).groupBy("domain", "w").count().collect():
        seen[domains.index(r["domain"])][r["w"]] = r["count"]
    logs = [[math.log((c + SMOOTH) / (sum(row) + SMOOTH * BUCKETS)) for c in row] for row in seen]
    means = [sum(column) / len(domains) for column in zip(*logs, strict=True)]
    weights = [[v - m for v, m in zip(row, means, strict=True)] for row in logs]
    model = Classifier(domains, [math.log(sizes[d][0] / total) for d in domains], edges, tables, weights)
    return tempered(model, held) if folds else model


def tempered(model: Classifier, held: DataFrame) -> Classifier:
    """With the temper of the least loss on held-out rows; all are judged in one pass."""
    at = F.array_position(F.array(*(F.lit(d) for d in model.domains)), F.col("domain")).cast("int") - 1
    rows = held.select(F.array(*model.surface(F.col("x"))).alias("s"), model.evidence(F.col("words")).alias("e"), F.size("words").alias("n"), at.alias("at"))
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, temper in enumerate(TEMPERS):
        p = model.posteriors(F.col("s"), F.col("e"), F.col("n"), temper)
        rows = rows.withColumn(f"p{i}", p)
        sums.append(F.avg(-F.log(F.greatest(F.get(f"p{i}", F.col("at")), F.lit(1e-9)))).alias(f"loss{i}"))
        sums.append(F.avg((F.get(f"p{i}", F.col("at")) == F.array_max(f"p{i}")).cast("double")).alias(f"right{i}"))
    row = rows.agg(*sums).first()
    best = min(range(len(TEMPERS)), key=lambda i: (row[f"loss{i}"], i))
    model.temper, model.held_out = TEMPERS[best], (row["rows"], row[f"right{best}"], row[f"loss{best}"])
    return model


def add_posteriors(df: DataFrame, model: Classifier, text: str) -> DataFrame:
    """Adds `tokens` and `p`, the posteriors; takes the column `text` away."""
    df = add_features(df, text).drop(text)
    df = df.withColumn("s", F.array(*model.surface(F.col("x")))).withColumn("e", model.evidence(F.col("words"))).withColumn("n", F.size("words"))
    return df.withColumn("p", model.posteriors(F.col("s"), F.col("e"), F.col("n"))).drop("x", "words", "s", "e", "n")


def rate(p: Column, steps: list[list[float]], most: float | None = None) -> Column:
    """The rate after the given gradient steps: r <- r - g . p, projected, from r = 1."""
    if not steps:
        return F.lit(1.0)
    history = F.split(F.lit(";".join(",".join(map(repr, g)) for g in steps)), ";")
    history = F.transform(history, lambda g: F.split(g, ",").cast("array<double>"))

    def step(r: Column, g: Column) -> Column:
        dot = F.lit(0.0)
        for d in range(len(steps[0])):
            dot = dot + g[d] * p[d]
        r = F.greatest(F.lit(0.0), r - dot)
        return r if most is None else F.least(F.lit(float(most)), r)

    return F.aggregate(history, F.lit(1.0), step)


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Least squares of a small symmetric system, with a little ridge."""
    import numpy as np

    m = np.array(a, float)
    ridge = 1e-9 * max(1e-12, float(np.trace(m)) / max(1, len(b)))
    return np.linalg.solve(m + ridge * np.eye(len(b)), np.array(b, float)).tolist()


def natural_totals(table: DataFrame, n: int) -> list[float]:
    row = table.agg(*(F.sum(F.col("tokens") * F.col("p")[d]) for d in range(n))).first()
    return [float(v or 0.0) for v in row]


def fit_rates(table: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE, most: float | None = None) -> tuple[list[list[float]], list[float]]:
    """(steps, totals reached). table: tokens (double), p (array). Projected gradient, scaled by the Gram
    matrix of documents whose rate is free; each step is one aggregation of D + D * D / 2 sums. Ends when the
    targets are met, when a step no longer comes nearer, or after `steps`."""
    n = len(targets)
    history: list[list[float]] = []
    best: tuple[float, int, list[float]] = (math.inf, 0, [0.0] * n)
    scale = max(sum(targets), 1.0)
    for i in range(steps + 1):
        current = table.withColumn("r", rate(F.col("p"), history, most))
        inside = (F.col("r") > 0) if most is None else (F.col("r") > 0) & (F.col("r") < most)
        free = F.when(inside, F.col("tokens")).otherwise(0.0)
        pairs = [(d, e) for d in range(n) for e in range(d, n)]
        row = current.agg(*(F.sum(F.col("r") * F.col("tokens") * F.col("p")[d]) for d in range(n)), *(F.sum(free * F.col("p")[d] * F.col("p")[e]) for d, e in pairs)).first()
        totals = [float(v or 0.0) for v in row[:n]]
        rest = [s - t for s, t in zip(totals, targets, strict=True)]
        loss = sum(v * v for v in rest)
        if loss < best[0] * (1 - 1e-6):
            best = (loss, i, totals)
        if i == steps or i > best[1] + 3 or max(map(abs, rest), default=0.0) <= close * scale:
            break
        gram = [[0.0] * n for _ in range(n)]
        for (d, e), v in zip(pairs, row[n:], strict=True):
            gram[d][e] = gram[e][d] = float(v or 0.0)
        if not any(gram[d][d] for d in range(n)):
            break
        history.append(solve(gram, rest))
    return history[: best[1]], best[2]


@dataclass
class Mixture:
    """table: row (a struct of the documents' columns), tokens, p, rate, copies; report: (domain, natural,
    target, reached tokens); classifier: None without labels."""

    table: DataFrame
    report: list[tuple[str, float, float, float]]
    classifier: Classifier | None


def mixture(docs: DataFrame, labels: DataFrame, domain: Column, weights, total: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, most: float | None = None) -> Mixture:
    """weights maps the natural token shares {domain: share} to target weights, which are then scaled to sum
    to `total` times the corpus' tokens; keep: the columns that `row` has, all by default; most: the highest rate."""
    columns = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), chance.alias("chance"), text.alias("text"))
    model = fit_classifier(docs, labels, domain, id_col, text_col)
    if model is None:
        tokens = F.size(F.array_remove(F.split("text", r"\s+"), ""))
        return Mixture(rows.select("row", tokens.alias("tokens"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies")), [], None)
    table = cut(add_posteriors(rows, model, "text").select("row", "tokens", "p", "chance"), "mixing-table")
    sums = table.where("tokens > 0").select(F.col("tokens").cast("double").alias("tokens"), "p")
    natural = natural_totals(sums, len(model.domains))
    everything = sum(natural)
    wanted = weights({d: v / max(everything, 1.0) for d, v in zip(model.domains, natural, strict=True)})
    wanted = [float(wanted.get(d, 0.0)) for d in model.domains]
    targets = [w / max(sum(wanted), 1e-12) * total * everything for w in wanted]
    steps, reached = fit_rates(sums, targets, most=most)
    rated = table.withColumn("rate", F.when(F.col("tokens") > 0, rate(F.col("p"), steps, most)).otherwise(1.0))
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("chance") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return Mixture(rated.withColumn("copies", copies).drop("chance"), list(zip(model.domains, natural, targets, reached, strict=True)), model)


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights, total: float = 1.0, id_col: str = "doc_id", text_col: str = "text", most: float | None = None) -> DataFrame:
    """The rows of `docs`, each as many times as its rate stands for."""
    found = mixture(docs, labels, domain, weights, total, id_col, text_col, most=most)
    return found.table.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
