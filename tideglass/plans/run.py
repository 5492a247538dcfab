"""A run from raw lines to the stored posts, and from there to signals, summary and report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import clean, dedup, features, validate, vectors
from tideglass.operators import signal as sg
from tideglass.session import cut
from tideglass.sources import files, sinks


def process(spark: SparkSession, lines: str, store: str, now: datetime | None = None, window_hours: int = 24) -> dict:
    """Cleans JSON lines, keeps those of the trailing window (all without `now`), drops exact and near
    duplicates and writes the rest to the store; returns the counters of all steps."""
    cleaned = cut(clean.clean(files.read_lines(spark, lines)), "run-clean")
    statuses = {r["status"]: r["count"] for r in cleaned.groupBy("status").count().collect()}
    posts = cleaned.where("status = 'clean'").drop("status")
    late = 0
    if now is not None:
        inside = clean.trailing_window(posts, now, window_hours)
        late = posts.count() - inside.count()
        posts = inside
    status = cut(dedup.dedup_status(posts), "run-dedup")
    counts = dedup.dedup_counters(status).first().asDict()
    written = sinks.write_store(status.where("status = 'kept'").drop("status"), store, mode="replace")
    return {"lines": sum(statuses.values()), "malformed": statuses.get("malformed", 0), "unusable": statuses.get("unusable", 0), "late": late, **counts, "written": written}


def analyse(spark: SparkSession, store: str, out: str, prices: DataFrame | None = None, minutes: int = 15, resamples: int = 1000) -> dict:
    """Signals of the stored posts as Parquet and CSV, the summary as JSON and a report, under `out`."""
    scored = cut(features.add_features(files.read_store(spark, store)), "run-features")
    signals = cut(sg.signal_with_intervals(scored, minutes, resamples), "run-signals")
    n = scored.count()
    weights = cut(vectors.tfidf_words_and_chars(scored, "tweet_id", "content", n), "run-terms")
    tested = validate.validate(signals, prices) if prices is not None else None
    words = weights.where("space = 'word'")
    found = sinks.summary(sg.corpus_summary(scored), sg.class_counts(scored), signals, vectors.density(weights, n), vectors.top_terms(words, n), tested)
    sinks.write_signals(signals, out)
    sinks.write_summary(spark, found, f"{out}/summary.json")
    live = [r.asDict() for r in signals.where("not sparse").orderBy("bucket_start").collect()]  # a row per bucket
    sinks.write_text(spark, sinks.report(found, live), f"{out}/report.md")
    return found
