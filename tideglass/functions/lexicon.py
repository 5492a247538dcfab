"""Lexicon scoring of short posts, as column expressions.

Score: the mean weight of what a post's body says, and how many things it says. Terms match whole
words, longest first, left to right; a negation among the three words before a term turns its sign.
Emoji count up to three times each, option legs each time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.text import W, strip_social

# Weights and their terms, emoji, option legs, negations, promotion and class words.
LEXICON: dict[str, float] = {
    "bullish": 0.90,
    "buy ce": 0.90,
    "ce buy": 0.90,
    "bull run": 0.85,
    "bulls in control": 0.85,
    "call buy": 0.85,
    "ce loaded": 0.85,
    "upper circuit": 0.85,
    "went long": 0.85,
    "all time high": 0.80,
    "breaking out": 0.80,
    "breakout": 0.80,
    "buy call": 0.80,
    "fii buy": 0.80,
    "fii buying": 0.80,
    "short covering": 0.80,
    "target achieved": 0.80,
    "tezi": 0.80,
    "tgt achieved": 0.80,
    "52 week high": 0.75,
    "fii long": 0.75,
    "higher high": 0.75,
    "reversal up": 0.75,
    "target hit": 0.75,
    "uptrend": 0.75,
    "accumulate": 0.70,
    "add on dips": 0.70,
    "ath": 0.70,
    "badhega": 0.70,
    "buy on dips": 0.70,
    "dii buying": 0.70,
    "gap up": 0.70,
    "long": 0.70,
    "outperform": 0.70,
    "rally": 0.70,
    "support holding": 0.70,
    "surge": 0.70,
    "up move": 0.70,
    "value buy": 0.70,
    "buy": 0.65,
    "upside": 0.65,
    "booked profit": 0.60,
    "bounce": 0.60,
    "btst": 0.60,
    "buying": 0.60,
    "highest ever": 0.60,
    "longs": 0.60,
    "profit booked": 0.60,
    "recovery": 0.60,
    "upar": 0.60,
    "strong": 0.55,
    "2x": 0.50,
    "beat": 0.50,
    "higher": 0.50,
    "ke liye ready": 0.50,
    "positive": 0.50,
    "took position": 0.50,
    "green": 0.45,
    "averaged": 0.40,
    "cheap": 0.40,
    "milestone": 0.40,
    "momentum": 0.40,
    "hold": 0.30,
    "resistance": -0.35,
    "exit": -0.40,
    "red": -0.45,
    "risky": -0.45,
    "caution": -0.50,
    "down": -0.50,
    "lower": -0.50,
    "miss": -0.50,
    "negative": -0.50,
    "profit booking": -0.50,
    "overvalued": -0.55,
    "weak": -0.55,
    "avoid": -0.60,
    "correction": -0.60,
    "dii selling": -0.60,
    "fall": -0.60,
    "fear": -0.60,
    "neeche": -0.60,
    "sell": -0.60,
    "shorts": -0.60,
    "decline": -0.65,
    "downside": -0.65,
    "falling": -0.65,
    "falls": -0.65,
    "selling": -0.65,
    "book loss": -0.70,
    "down move": -0.70,
    "gap down": -0.70,
    "girega": -0.70,
    "points down": -0.70,
    "short": -0.70,
    "trapped": -0.70,
    "underperform": -0.70,
    "52 week low": -0.75,
    "downtrend": -0.75,
    "dump": -0.75,
    "fii short": -0.75,
    "girawat": -0.75,
    "long unwinding": -0.75,
    "lower low": -0.75,
    "market decline": -0.75,
    "breakdown": -0.80,
    "breaking down": -0.80,
    "fii sell": -0.80,
    "fii selling": -0.80,
    "mandi": -0.80,
    "panic": -0.80,
    "sell off": -0.80,
    "selloff": -0.80,
    "short buildup": -0.80,
    "shorting": -0.80,
    "sl hit": -0.80,
    "sl triggered": -0.80,
    "stop loss hit": -0.80,
    "stoploss hit": -0.80,
    "bear market": -0.85,
    "bears in control": -0.85,
    "lower circuit": -0.85,
    "pe loaded": -0.85,
    "put buy": -0.85,
    "went short": -0.85,
    "bearish": -0.90,
    "bears completely in control": -0.90,
    "buy pe": -0.90,
    "crash": -0.90,
    "pe buy": -0.90,
}
EMOJI = {"🚀": 0.9, "📈": 0.8, "🟢": 0.6, "💚": 0.5, "🐂": 0.85, "⬆": 0.6, "🔥": 0.4, "💪": 0.5, "🎯": 0.4, "📉": -0.8, "🔴": -0.6, "❤": -0.3, "🐻": -0.85, "⬇": -0.6, "💀": -0.7, "😭": -0.6, "🩸": -0.75, "⚠": -0.4}
LEG_WEIGHT = 0.6
NEGATIONS = ("not", "no", "never", "isn't", "wasn't", "won't", "don't", "doesn't", "didn't", "nahi", "nai")
NEGATION_WINDOW = 3
PROMO = r"join my|telegram|link in (the )?(profile|bio)|dm for|paid group|subscribe now|whatsapp group"
EARNINGS = r"yoy|qoq|ebitda|pat|pbt|revenue|margin|net profit|results|q[1-4]fy[0-9]{2}|topline|bottomline"
CORPORATE = r"sebi|dividend|bonus issue|buyback|rights issue|stock split|delisting"
MECHANICAL = r"straddle|strangle|spot price|open interest|oi data|vix|max pain|pcr|cas|closing auction"

LONGEST_FIRST = sorted(LEXICON, key=lambda t: (-len(t), t))


def one_of(terms, at: int = 0) -> str:
    """A pattern of the terms as a tree of prefixes, the longest first: a start of a word is tried once, not once a term."""
    heads = sorted({t[at] for t in terms if len(t) > at})
    found = [re.escape(h).replace(r"\ ", " ") + one_of([t for t in terms if len(t) > at and t[at] == h], at + 1) for h in heads]
    if any(len(t) == at for t in terms):
        found.append("")
    return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"


TERM = rf"(?<!{W})({one_of(LONGEST_FIRST)})(?!{W})"
# A text with no negation word at all turns no sign. The gaps between terms, the last one included.
NEGATION = rf"(?<!{W})(?:{'|'.join(NEGATIONS)})(?!{W})"
GAP = rf"(?s)(.*?)(?:{TERM}|\z)"
LEG = rf"(?i)(?<!{W})(\p{{Nd}}{{4,6}})\s*(ce|pe)(?!{W})"
DOUBLES = "array<double>"


def promo(text: Column) -> Column:
    return F.rlike(text, F.lit(f"(?iu){PROMO}"))


def content_class(text: Column) -> Column:
    def has(words: str) -> Column:
        return F.rlike(text, F.lit(rf"(?iu)(?<!{W})(?:{words})(?!{W})"))

    return F.when(has(EARNINGS), "earnings").when(has(CORPORATE), "corporate_action").when(has(MECHANICAL), "mechanical").otherwise("discussion")


def weights_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in LEXICON.items() for x in pair))


def last_words(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    return F.slice(words, F.greatest(F.size(words) - (NEGATION_WINDOW - 1), F.lit(1)), F.lit(NEGATION_WINDOW))


def term_weights(lowered: Column) -> Column:
    """Signed weights of the terms in order. Where the text has a negation, one fold over (text before the
    term, term), which carries on the last words only, so its time grows with the text.

    Patterns go through functions that keep them: `split` compiles its own for every row."""
    found = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(1))
    gaps = F.regexp_extract_all(lowered, F.lit(GAP), F.lit(1))
    weights = weights_map()
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("term"))
    state = F.struct(F.lit("").alias("read"), F.array().cast(DOUBLES).alias("out"))

    def step(s: Column, p: Column) -> Column:
        read = F.concat(s["read"], p["gap"])
        turned = F.exists(last_words(read), lambda t: F.btrim(t, F.lit(".,!?")).isin(*NEGATIONS))
        w = F.element_at(weights, p["term"])
        out = F.when(p["term"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.when(turned, -w).otherwise(w))))
        # what is read ends with the term, so its last word may go on in the next gap
        return F.struct(F.array_join(last_words(F.concat(read, F.coalesce(p["term"], F.lit("")))), " ").alias("read"), out.alias("out"))

    plain = F.transform(found, lambda t: F.element_at(weights, t))
    return F.when(F.rlike(lowered, F.lit(NEGATION)), F.aggregate(pairs, state, step, lambda s: s["out"])).otherwise(plain)


def emoji_count(body: Column, glyph: str) -> Column:
    n = (F.length(body) - F.length(F.replace(body, F.lit(glyph), F.lit("")))) / len(glyph)
    return F.least(n.cast("int"), F.lit(3))


def emoji_weights(body: Column) -> Column:
    ascii_only = F.octet_length(body) == F.length(body)
    return F.when(ascii_only, F.array().cast(DOUBLES)).otherwise(_emoji_weights(body))


def _emoji_weights(body: Column) -> Column:
    return F.flatten(F.array(*(F.array_repeat(F.lit(w), emoji_count(body, e)) for e, w in EMOJI.items())))


def leg_weights(body: Column) -> Column:
    legs = F.regexp_extract_all(body, F.lit(LEG), F.lit(2))
    return F.transform(legs, lambda x: F.when(F.lower(x) == "ce", LEG_WEIGHT).otherwise(-LEG_WEIGHT))


def add_score(df, text: str = "content"):
    """Adds polarity (double), evidence (int) and is_promo to a frame."""
    body = strip_social(F.col(text))
    df = df.withColumn("__body", body).withColumn("__scores", F.concat(term_weights(F.lower("__body")), emoji_weights(F.col("__body")), leg_weights(F.col("__body"))))
    total = F.aggregate("__scores", F.lit(0.0), lambda s, x: s + x)
    return df.withColumns({
        "polarity": F.when(F.size("__scores") == 0, 0.0).otherwise(total / F.size("__scores")),
        "evidence": F.size("__scores"),
        "is_promo": promo(F.col(text)),
    }).drop("__body", "__scores")
