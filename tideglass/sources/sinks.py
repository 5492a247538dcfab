"""Writers: JSON lines, checkpoint keys, the partitioned store, signals, summary and report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators.clean import partition_columns


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_keys(done: DataFrame, path: str) -> None:
    """Marks units as complete; call it after their rows are written."""
    done.select("key").write.mode("append").text(path)


def write_store(posts: DataFrame, path: str, mode: str = "append", rows_per_file: int = 0) -> int:
    """Posts under date= and hour= in Parquet with ZSTD; returns how many. No rows write nothing.

    mode `replace` swaps only the partitions that are in `posts`, so a shorter rerun leaves no stale rows."""
    if posts.isEmpty():
        return 0
    from pyspark.sql import Observation

    watch = Observation("written")
    rows = partition_columns(posts).observe(watch, F.count(F.lit(1)).alias("n"))
    writer = rows.repartition("date", "hour").write.partitionBy("date", "hour").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        writer = writer.mode(mode)
    writer.parquet(path)
    return int(watch.get["n"])


def write_signals(signals: DataFrame, path: str) -> None:
    """The bucket signals, a small table, as one Parquet and one CSV file."""
    one = signals.coalesce(1).sortWithinPartitions("bucket_start")
    one.write.mode("overwrite").parquet(f"{path}/signals.parquet")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/signals.csv")


def summary(corpus: DataFrame, classes: DataFrame, signals: DataFrame, density: DataFrame, terms: DataFrame, validation: DataFrame | None = None) -> dict:
    """The summary of a run out of small frames."""
    # fixed values: the keys of the summary's format
    c, d = corpus.first().asDict(), density.first().asDict()
    buckets = signals.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sparse")).alias("live")).first()
    rows = validation.orderBy("horizon_minutes").collect() if validation is not None else []
    return {
        "n_tweets": c["n_tweets"],
        "n_unique_authors": c["n_unique_authors"],
        "content_classes": {r["content_class"]: r["n"] for r in classes.orderBy(F.desc("n"), "content_class").collect()},
        "pct_scoreable": c["pct_scoreable"],
        "pct_promotional": c["pct_promotional"],
        "mean_polarity": c["mean_polarity"],
        "n_buckets": buckets["n"],
        "n_buckets_live": buckets["live"],
        "tfidf_shape": [d["n_docs"], d["n_terms"]],
        "tfidf_density_pct": d["density_pct"],
        "top_tfidf_terms": [[r["term"], r["mean_weight"]] for r in terms.collect()],
        "validation": [{"horizon_minutes": r["horizon_minutes"], "n_buckets": r["n"], "pearson_r": r["pearson_r"], "pearson_p": r["pearson_p"], "spearman_r": r["spearman_r"], "spearman_p": r["spearman_p"], "hit_rate": r["hit_rate"], "hit_rate_ci": [r["hit_low"], r["hit_high"]]} for r in rows],
    }


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_summary(spark: SparkSession, found: dict, path: str) -> None:
    write_text(spark, json.dumps(found, indent=2), path)


def report(found: dict, live: list[dict]) -> str:
    """A Markdown report of a summary and the live buckets; whether anything is significant is computed."""
    lines = ["# Analysis", "", "## Corpus", ""]
    lines += [f"- Posts: {found['n_tweets']:,}", f"- Authors: {found['n_unique_authors']:,}", f"- Mean polarity: {found['mean_polarity']:+.3f}", f"- With a scoreable term: {found['pct_scoreable']:.1%}", f"- Promotional: {found['pct_promotional']:.1%}", "", "| Class | Posts |", "|---|---:|"]
    lines += [f"| {k} | {n:,} |" for k, n in found["content_classes"].items()]
    lines += ["", "## Signal", "", f"{found['n_buckets']} buckets, {found['n_buckets_live']} above the floor.", "", "| Time (IST) | Posts | Scoreable | Signal | 95% CI | Bullish share |", "|---|---:|---:|---:|---|---:|"]
    for s in live:
        share = "-" if s["bull_share"] is None else f"{s['bull_share']:.0%} [{s['bull_ci_low']:.0%}, {s['bull_ci_high']:.0%}]"
        lines.append(f"| {s['bucket_start_ist']:%d %b %H:%M} | {s['n_tweets']} | {s['n_scoreable']} | {s['signal']:+.3f} | [{s['ci_low']:+.3f}, {s['ci_high']:+.3f}] | {share} |")
    lines += ["", "## Against returns", ""]
    if found["validation"]:
        lines += ["| Horizon | n | Pearson r | p | Spearman r | p | Hit rate |", "|---|---:|---:|---:|---:|---:|---|"]
        for r in found["validation"]:
            lines.append(f"| {r['horizon_minutes']}m | {r['n_buckets']} | {r['pearson_r']:+.3f} | {r['pearson_p']:.3f} | {r['spearman_r']:+.3f} | {r['spearman_p']:.3f} | {r['hit_rate']:.1%} [{r['hit_rate_ci'][0]:.0%}, {r['hit_rate_ci'][1]:.0%}] |")
        few = [r["horizon_minutes"] for r in found["validation"] if r["pearson_p"] is not None and r["pearson_p"] < 0.05]
        lines += ["", f"Significant at 5%: {', '.join(f'{h}m' for h in few) or 'none'}."]
    else:
        lines.append("Too few aligned buckets.")
    lines += ["", "## Terms", "", "| Term | Mean weight |", "|---|---:|"] + [f"| `{t}` | {w:.4f} |" for t, w in found["top_tfidf_terms"][:15]]
    return "\n".join(lines) + "\n"
