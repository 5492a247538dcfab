"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

Lexicon: the terms whose document frequency lies in a band of inverse document frequency, counted
over all documents. Terms are hashed to SLOTS slots and frequencies are kept per slot, so the
lexicon is a bitmap of SLOTS bits (512 KB) at any corpus size and is tested inside the scan,
without a join.

Fingerprint: the text's distinct terms in the lexicon are sorted and hashed; then one hash for all of
them, and one for each randomised lexicon subset. Subsets come in tiers that keep 1/4, 1/32, 1/256
and 1/2048 of the lexicon, so that for a text of any length some subsets hold one or two of its
terms and survive an edit elsewhere. The likeness of two fingerprints is the share of agreeing
subset hashes among subsets that are not empty in both.

Defined results: null text counts as empty; a text without lexicon terms is fingerprinted by all its
terms; texts without any term share the empty fingerprint, and two of these have likeness 1; equal
texts have equal fingerprints. For `with_next`: order is doc_id (nulls last), then text; repeated
rows are rows of their own; after the last row comes the first; one row alone is its own next. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 1 << 22
#: A lexicon term stands in one document out of 10 at most, and in one of 2000 at least.
OFTEN, SELDOM = 1 / 10, 1 / 2000
#: (bit of the term's hash from which the tier reads, bits it reads, subsets it has: a power of two)
TIERS = ((24, 2, 4), (26, 5, 8), (31, 8, 16), (39, 11, 32))
SEPARATOR = r"[\s\p{Punct}]+"
#: Rows that stand together while each meets its successor, and the most such groups.
GROUP_ROWS, MOST_GROUPS = 1024, 10_000


def terms_of(text: Column) -> Column:
    """Distinct terms in no order; an empty string may be among them."""
    return F.array_distinct(F.split(F.lower(text), SEPARATOR))


def slot_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def lexicon(docs: DataFrame, text_col: str = "text", often: float = OFTEN, seldom: float = SELDOM) -> list[int]:
    """The bitmap: SLOTS / 64 longs, whatever the corpus."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.count()
    terms = docs.select(F.explode(terms_of(text)).alias("term")).where("term != ''")
    counts = terms.groupBy(slot_of(F.col("term")).alias("slot")).agg(F.count(F.lit(1)).alias("df"))
    inside = counts.where((F.col("df") >= seldom * rows) & (F.col("df") <= often * rows))
    words = inside.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits")).toArrow()
    found = dict(zip(words.column("at").to_pylist(), words.column("bits").to_pylist(), strict=True))
    return [found.get(i, 0) for i in range(SLOTS // 64)]


def bitmap_column(bitmap: list[int]) -> Column:
    """A literal that the optimizer folds into one array."""
    return F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")


def masked(hashes: str, mask: int, value: int) -> Column:
    """Of an array of hashes, those that have `value` in the bits of `mask`."""
    return F.filter(hashes, lambda h: h.bitwiseAND(F.lit(mask)) == F.lit(value))


def add_fingerprint(df: DataFrame, text: str, out: str, bitmap: Column) -> DataFrame:
    """Adds `out`_all (bigint) and `out`_parts (array of bigint, null for empty subsets) from the column `text`."""

    terms, slots, kept, hashes = f"{out}_terms", f"{out}_slots", f"{out}_kept", f"{out}_hashes"

    def inside(_: Column, i: Column) -> Column:
        slot = F.get(slots, i)
        return F.getbit(F.get(bitmap, F.shiftright(slot, 6)), slot % 64) == 1

    df = df.withColumn(terms, F.array_remove(terms_of(F.col(text)), ""))
    df = df.withColumn(slots, F.transform(terms, slot_of))
    df = df.withColumn(kept, F.filter(terms, inside))
    df = df.withColumn(kept, F.sort_array(F.when(F.size(kept) > 0, F.col(kept)).otherwise(F.col(terms))))
    df = df.withColumn(hashes, F.transform(kept, lambda t: F.xxhash64(t))).drop(terms, slots, kept)
    tiers, parts = [], []
    for i, (low, bits, subsets) in enumerate(TIERS):
        every, used = (1 << bits) - 1, subsets - 1
        tiers.append(masked(hashes, (every ^ used) << low, 0).alias(f"{out}_tier{i}"))
        for k in range(subsets):
            mine = masked(f"{out}_tier{i}", used << low, k << low)
            parts.append(F.when(F.size(mine) > 0, F.xxhash64(mine)))
    df = df.select("*", F.xxhash64(hashes).alias(f"{out}_all"), *tiers).drop(hashes)
    return df.withColumn(f"{out}_parts", F.array(*parts)).drop(*(f"{out}_tier{i}" for i in range(len(TIERS))))


def fingerprint_string(whole: Column, parts: Column) -> Column:
    """Hex of the hash of all terms, then four digits for each subset, dots where it is empty."""
    four = F.transform(parts, lambda h: F.coalesce(F.lpad(F.hex(h.bitwiseAND(0xFFFF)), 4, "0"), F.lit("....")))
    return F.lower(F.concat(F.lpad(F.hex(whole), 16, "0"), F.lit(":"), F.array_join(four, "")))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of subset hashes: 0 to 1."""
    one = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 0).when(x.eqNullSafe(y), 10_001).otherwise(1))
    total = F.aggregate(one, F.lit(0), lambda s, v: s + v)
    return F.when(total == 0, 1.0).otherwise(F.floor(total / 10_000) / (total % 10_000))


def with_groups(docs: DataFrame, id_col: str, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int]:
    """Ranges of ids: adds `group`, `guest` (the row is a copy that only serves as the successor of its
    group's last row) and `wrap` (it is the copy of the first row, behind the last one)."""
    ids = docs.select(F.col(id_col).alias("i"))
    stats = ids.agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).first()
    groups = max(1, min(MOST_GROUPS, -(-stats["n"] // group_rows)))
    cuts = ids.agg(F.percentile_approx("i", [k / groups for k in range(1, groups)], 100_000)).first()[0] if groups > 1 else []
    bounds = sorted({x for x in cuts or [] if x != stats["first"]})
    at = F.col(id_col)
    kind = docs.schema[id_col].dataType
    bound = F.array(*(F.lit(x).cast(kind) for x in bounds)) if bounds else None
    last = len(bounds)
    # binary search for the number of bounds at or below the id; nulls go last
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(last.bit_length()))))
    group = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(bound, p + s - 1) <= at, p + s).otherwise(p)) if bounds else F.lit(0)
    group = F.when(at.isNull(), last).otherwise(group)
    places = [F.struct(group.alias("group"), F.lit(False).alias("guest"), F.lit(False).alias("wrap"))]
    if bounds:
        starts = F.array_contains(bound, at)
        places.append(F.when(starts, F.struct((group - 1).alias("group"), F.lit(True).alias("guest"), F.lit(False).alias("wrap"))))
    first = at.eqNullSafe(F.lit(stats["first"]).cast(kind))
    places.append(F.when(first, F.struct(F.lit(last).alias("group"), F.lit(True).alias("guest"), F.lit(True).alias("wrap"))))
    placed = docs.withColumn("__place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())))
    return placed.select(*docs.columns, "__place.*"), last + 1


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, often: float = OFTEN, seldom: float = SELDOM) -> DataFrame:
    """Each row's fingerprint, that of its edited text (the last quarter replaced by the beginning of
    the next row's text), and its likeness to that and to the next row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bitmap = bitmap_column(lexicon(source, "text", often, seldom))
    placed, _ = with_groups(source, "doc_id", group_rows)
    order = Window.partitionBy("group").orderBy("wrap", F.col("doc_id").isNull(), "doc_id", "text", "guest")
    rows = placed.select("*", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("nth"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("group", "nth", "guest", "doc_id", n.cast("bigint").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)).alias("edited"))
    rows = add_fingerprint(rows, "text", "own", bitmap)
    rows = add_fingerprint(rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)), "edited", "new", bitmap)
    rows = rows.drop("text", "edited").withColumn("next_parts", F.lead("own_parts").over(Window.partitionBy("group").orderBy("nth")))
    return rows.where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_string(F.col("own_all"), F.col("own_parts")).alias("fingerprint"),
        fingerprint_string(F.col("new_all"), F.col("new_parts")).alias("edited_fingerprint"),
        likeness(F.col("own_parts"), F.col("new_parts")).alias("near_edited"),
        likeness(F.col("own_parts"), F.col("next_parts")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, text_col: str = "text", often: float = OFTEN, seldom: float = SELDOM) -> DataFrame:
    """The columns of `docs` and their fingerprint."""
    bitmap = bitmap_column(lexicon(docs, text_col, often, seldom))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = add_fingerprint(rows, "text", "own", bitmap)
    return rows.select("row.*", fingerprint_string(F.col("own_all"), F.col("own_parts")).alias("fingerprint"))
