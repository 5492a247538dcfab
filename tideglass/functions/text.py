"""Text expressions: normalising, entities, counts, shingles.

Word characters follow Unicode letters, digits and underscore without combining marks, so that a
hashtag in Devanagari ends at its first vowel sign."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word character, a URL, a hashtag and a mention.
W = r"[\p{L}\p{N}_]"
URL = r"https?://\S+"
HASHTAG = rf"[#＃]{W}+"
MENTION = rf"@{W}+"


def nfkc(text: Column) -> Column:
    """Unicode normal form KC of whole Arrow batches; Spark has no function for it."""
    return F.arrow_udf(_nfkc_batch, "string")(text)


def _nfkc_batch(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts.cast(pa.string()), form="NFKC")


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's own expressions are computed at each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tidy(text: Column) -> Column:
    """The part of normalising that needs no Python: invisible characters, blanks, newlines, ends."""
    t = F.regexp_replace(text, r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{feff}]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """NFKC, then tidy; null is empty. `operators.clean.normalised` spares Python the ASCII texts."""
    return tidy(nfkc(F.coalesce(text, F.lit(""))))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"#({W}+)"), F.lit(1))


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\$([A-Za-z]{1,6})"), F.lit(1))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"@({W}+)"), F.lit(1))


def abbreviated_count(text: Column) -> Column:
    """'1.2K' -> 1200; 0 where the text is no such number."""
    t = F.trim(F.coalesce(text, F.lit("")))
    form = r"(?i)^([0-9.,]+)\s*([KMB]?)$"
    number = F.replace(F.regexp_extract(t, form, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.upper(F.regexp_extract(t, form, 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce(F.floor(number * factor), F.lit(0)).cast("bigint")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def nth_segment(url: Column, n: int) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(n))


def strip_social(text: Column) -> Column:
    """Hashtags, then URLs, then mentions, each to a blank."""
    for pattern in (HASHTAG, URL, MENTION):
        text = F.regexp_replace(text, pattern, " ")
    return text


def strip_links(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://\S+|t\.co/\S+", " ")


def dedup_form(text: Column) -> Column:
    """Lower case without URLs, blanks of any script folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)https?://\S+", ""), r"(?U)\s+", " "))


def shingles(norm: Column, k: int = 3) -> Column:
    """Distinct runs of k tokens; a shorter text is one shingle, be it empty."""

    def runs(tokens: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (k - 1), F.lit(1)))
        each = F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(tokens, i + (j - 1)) for j in range(k))))
        return F.when(F.size(tokens) < k, F.array(norm)).otherwise(F.array_distinct(each))

    return let(F.filter(F.split(norm, " "), lambda t: t != ""), runs)
