"""Named queries over the driver tables. Their DuckDB twins are in `oracles`.

Every query runs over its whole tables. Times leave as text, floats are rounded to six places, so
that engines can be compared by value."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions import text as tx
from tideglass.functions.lexicon import add_score, content_class, emoji_count, leg_weights, promo
from tideglass.functions.stats import wilson
from tideglass.operators import clean as cl
from tideglass.operators import dedup, features, planner, series, validate, vectors
from tideglass.operators import signal as sg
from tideglass.plans.oracles import EMOJI_SHOWN, NOW_EPOCH
from tideglass.plans.posts import EMOJI_TEMPLATES, posts, prices
from tideglass.session import spread

QUERIES: dict = {}
NOW = datetime.fromtimestamp(NOW_EPOCH, tz=timezone.utc)


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6)


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def big(c):
    return F.col(c).cast("bigint").alias(c) if isinstance(c, str) else c.cast("bigint")


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def scored(spark, d):
    return features.add_features(spread(posts(spark, d), "tweet_id"))


def signals(spark, d, minutes=60):
    return sg.bucket_signal(scored(spark, d), minutes)


def flagship(spark, d) -> DataFrame:
    return signal_frame(signals(spark, d, 360))


def signal_frame(s):
    return s.select(stamp("bucket_start").alias("bucket_start"), "n_tweets", "n_scoreable", *(r6(c).alias(c) for c in ("signal", "bull_share", "bull_ci_low", "bull_ci_high", "mean_engagement")), "sparse")


@query
def bucket_signal(spark, d):
    return signal_frame(signals(spark, d))


@query
def bucket_signal_quarter_hours(spark, d):
    return signal_frame(signals(spark, d, 15))


@query
def bucket_counts(spark, d):
    p = posts(spark, d)
    return p.groupBy(sg.bucket_of(F.col("created_at"), 15).alias("b")).agg(F.count(F.lit(1)).alias("n_tweets"), F.count_distinct("user_id").alias("n_users")).select(stamp("b").alias("bucket_start"), "n_tweets", "n_users")


@query
def live_span(spark, d):
    s = sg.live_span(signals(spark, d, 15))
    return s.select(stamp("first_live").alias("first_live"), stamp("last_live").alias("last_live"), stamp(validate.to_exchange(F.col("first_live"))).alias("first_live_ist"), "n_live")


@query
def wilson_intervals(spark, d):
    n = posts(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("like_count") > 50).alias("k"))
    w = wilson(F.col("k"), F.col("n"))
    return n.select("user_id", "n", "k", r6(w["low"]).alias("low"), r6(w["high"]).alias("high"))


@query
def bootstrap_ci(spark, d):
    rows = features.add_weight(scored(spark, d)).withColumn("b", F.unix_timestamp(sg.bucket_of(F.col("created_at"), 360)))
    ends = sg.bootstrap(rows, "b", "polarity", "weight", "tweet_id", keep=F.col("evidence") > 0)
    return ends.select("b", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query
def poisson_bootstrap_ci(spark, d):
    rows = features.add_weight(scored(spark, d)).withColumn("b", F.unix_timestamp(sg.bucket_of(F.col("created_at"), 360)))
    return sg.poisson_bootstrap(rows, "b", "polarity", "weight", "tweet_id", keep=F.col("evidence") > 0)


@query
def composite_weights(spark, d):
    return features.add_weight(scored(spark, d)).select("tweet_id", r6("weight").alias("weight"))


@query
def lexicon_score(spark, d):
    return add_score(posts(spark, d)).select("tweet_id", r6("polarity").alias("polarity"), "evidence", "is_promo")


@query
def classify(spark, d):
    return posts(spark, d).select("tweet_id", content_class(F.col("content")).alias("content_class"))


@query
def promo_flag(spark, d):
    return posts(spark, d).groupBy("lang").agg(F.count_if(promo(F.col("content"))).alias("n_promo"), F.count(F.lit(1)).alias("n"))


@query
def emoji_legs(spark, d):
    body = tx.strip_social(F.col("content"))
    return posts(spark, d, EMOJI_TEMPLATES).select("tweet_id", *(emoji_count(body, e).alias(n) for n, e in EMOJI_SHOWN.items()), F.size(leg_weights(body)).alias("n_legs"))


@query
def post_features(spark, d):
    return scored(spark, d).select("tweet_id", *(r6(c).alias(c) for c in ("polarity", "engagement", "authority", "confidence")), F.col("evidence").cast("int").alias("evidence"), "is_promo", "content_class")


@query
def corpus_summary(spark, d):
    s = sg.corpus_summary(scored(spark, d))
    return s.select("n_tweets", "n_unique_authors", *(r6(c).alias(c) for c in ("pct_scoreable", "pct_promotional", "mean_polarity")))


@query
def class_counts(spark, d):
    return sg.class_counts(scored(spark, d))


@query
def distinct_authors(spark, d):
    return posts(spark, d).groupBy("lang").agg(F.count_distinct("username").alias("n_authors"))


@query
def mergeable_signal(spark, d):
    s = sg.weighted_mean_of_sums(sg.mergeable_sums(scored(spark, d), 60))
    return s.select(stamp("bucket_start").alias("bucket_start"), r6("signal").alias("signal"))


def raw_lines(spark, d):
    """JSON lines of the posts: some cut off, some without id, date or text, some blank."""
    p = posts(spark, d)
    i = F.col("tweet_id")
    user = F.struct(F.col("user_id").alias("id"), "username", F.col("followers").alias("followersCount"), (i % 4 == 0).alias("verified"), (i % 6 == 0).alias("blue"))
    row = F.struct(
        F.when(i % 41 == 0, F.lit("0")).otherwise(i.cast("string")).alias("id"),
        F.when(i % 43 == 0, F.lit("2024")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("date"),
        F.when(i % 47 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.col("content"), F.lit("\t "))).alias("rawContent"),
        user.alias("user"), F.when(i % 5 != 0, F.col("lang")).alias("lang"), F.col("like_count").alias("likeCount"), F.col("retweet_count").alias("retweetCount"),
        F.when(i % 3 != 0, F.col("reply_count")).alias("replyCount"), F.col("quote_count").alias("quoteCount"), F.when(i % 2 == 0, F.lit("1.5")).otherwise((i * 3).cast("string")).alias("viewCount"),
        F.array(F.lit("Nifty"), F.lit("")).alias("hashtags"), F.when(i % 9 == 0, F.array(F.lit("tcs"))).alias("cashtags"),
        F.array(F.struct(F.lit("ann").alias("username"))).alias("mentionedUsers"),
        F.when(i % 10 == 1, F.struct(F.lit(1).alias("id"))).alias("retweetedTweet"), F.when(i % 8 == 0, i).alias("inReplyToTweetId"), (i % 7 == 0).alias("isQuoteStatus"),
    )
    lines = p.select(i.alias("i"), F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))
    return lines.select(F.col("i").alias("ingest_seq"), F.expr("CASE WHEN i % 37 = 0 THEN left(line, length(line) - 5) WHEN i % 53 = 0 THEN '   ' ELSE line END").alias("value"))


@query
def clean_posts(spark, d):
    c = cl.clean(raw_lines(spark, d)).where("status = 'clean'")
    return c.select(
        "tweet_id", stamp("created_at").alias("created_at"), "username", "user_id", "followers", "content", "lang", "reply_count", "retweet_count", "like_count", "quote_count", "view_count",
        *(F.array_join(x, ",").alias(x) for x in ("hashtags", "cashtags", "mentions")), "is_retweet", "is_reply", "is_quote", "verified", "conversation_id",
    )


@query
def clean_counters(spark, d):
    return cl.run_counters(cl.clean(raw_lines(spark, d)), NOW - timedelta(hours=24))


@query
def window_filter(spark, d):
    return cl.trailing_window(posts(spark, d), NOW, 24 * 7).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), stamp(F.min("created_at")).alias("first"))


@query
def partition_columns(spark, d):
    return cl.partition_columns(posts(spark, d)).groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"))


@query
def entity_extract(spark, d):
    c = F.col("content")
    return posts(spark, d).select("tweet_id", F.array_join(tx.hashtags(c), ",").alias("hashtags"), F.array_join(tx.cashtags(c), ",").alias("cashtags"), F.array_join(tx.mentions(c), ",").alias("mentions"))


@query
def parse_count(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("", "K", "m", " B", "x"))), (i % 5 + 1).cast("int"))
    shown = F.concat((i % 900).cast("string"), F.when(i % 2 == 0, F.concat(F.lit("."), (i % 10).cast("string"))).otherwise(F.when(i % 3 == 0, ",123").otherwise("")), unit)
    return e.select("event_id", tx.abbreviated_count(shown).alias("n"))


@query
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", tx.last_segment(u).alias("last"), tx.nth_segment(u, 3).alias("host"))


@query
def permalink_records(spark, d):
    p = posts(spark, d)
    rows = p.select(F.concat(F.lit("https://x.org/"), F.col("username"), F.lit("/status/"), F.col("tweet_id"), F.lit("/")).alias("permalink"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), F.col("content").alias("text"), F.lit("1.2K").alias("reply"), F.lit("3").alias("retweet"), F.lit("x").alias("like"))
    return cl.permalink_record(rows).select("id", stamp("date").alias("date"), "username", "reply_count", "retweet_count", "like_count", F.size("hashtags").alias("n_hashtags"))


@query
def exact_dedup(spark, d):
    return dedup.first_of_each(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query
def dedup_stats(spark, d):
    flagged = dedup.with_duplicate_flag(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_duplicate").alias("exact_dupes"), F.count_if(~F.col("is_duplicate")).alias("kept"))


@query
def shingle_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tx.shingles(tx.dedup_form(F.col("text")))).alias("n_shingles"))


@query
def jaccard_pairs(spark, d):
    p = dedup.similar_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 0.5)
    return p.select("a", "b", r6("similarity").alias("similarity"))


@query
def minhash_signature(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", tx.shingles(tx.dedup_form(F.col("text"))).alias("s"))
    s = dedup.signatures(rows, "item_id", "s", 8, dedup.stable_hash)
    return s.select("item_id", *(F.col("signature")[i].alias(f"m{i}") for i in range(8)))


@query
def near_dedup_greedy(spark, d):
    return dedup.near_dedup(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query
def near_dedup_counters(spark, d):
    rows = posts(spark, d).select("tweet_id", F.col("tweet_id").alias("ingest_seq"), "content")
    return dedup.dedup_counters(dedup.dedup_status(rows))


@query
def forward_returns(spark, d):
    p = validate.forward_returns(prices(spark, d), 30)
    return p.select(stamp("bar_ts").alias("bar_ts"), r6("close").alias("close"), r6("fwd_ret").alias("fwd_ret"))


@query
def asof_join(spark, d):
    left = table(spark, d, "events").where("event_type = 'click'").select("event_id", "ts")
    found = validate.asof_join(left, prices(spark, d), "ts", "bar_ts", ["close"], 900)
    return found.select("event_id", r6("close").alias("close"))


def aligned(spark, d):
    live = signals(spark, d).where("not sparse").select("bucket_start", "signal")
    return validate.asof_join(live, validate.forward_returns(prices(spark, d), 30).select("bar_ts", "fwd_ret"), "bucket_start", "bar_ts", ["fwd_ret"], 3600)


@query
def correlation(spark, d):
    c = validate.correlation(aligned(spark, d), "signal", "fwd_ret")
    return c.select("n", *(r6(x).alias(x) for x in ("pearson_r", "pearson_p", "spearman_r", "spearman_p")))


@query
def hit_rate(spark, d):
    c = validate.correlation(aligned(spark, d), "signal", "fwd_ret")
    return c.select("n", "hits", *(r6(x).alias(x) for x in ("hit_rate", "hit_low", "hit_high")))


@query
def validation(spark, d):
    return validate.validate(signals(spark, d), prices(spark, d), tolerance_minutes=60)


@query
def market_hours(spark, d):
    p = posts(spark, d)
    return p.select("tweet_id", validate.market_hours(F.col("created_at")).alias("open"))


@query
def average_rank(spark, d):
    return validate.average_rank(posts(spark, d), "like_count", "rank", ("lang",)).select("tweet_id", r6("rank").alias("rank"))


@query
def gap_breaks(spark, d):
    b = signals(spark, d, 15).where("not sparse").select("bucket_start", "signal")
    g = series.gap_breaks(b, "bucket_start", ["signal"])
    return g.select(stamp("bucket_start").alias("bucket_start"), "is_break", r6("signal").alias("signal"))


@query
def every_nth(spark, d):
    return series.every_nth(prices(spark, d), 7, "bar_ts").select(stamp("bar_ts").alias("bar_ts"), r6("close").alias("close"))


@query
def lttb(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("x"), F.col("value").alias("y"))
    return series.lttb(p, 100)


@query
def spike_demo(spark, d):
    return series.spike_demo(spark)


def histogram_frame(h):
    return h.select(big("bin"), r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query
def histogram(spark, d):
    return histogram_frame(series.histogram(table(spark, d, "lineitem"), F.col("l_extendedprice"), 50, 0.0, 50000.0))


@query
def engagement_histogram(spark, d):
    h = series.engagement_histogram(posts(spark, d))
    return h.select(big("bin"), r6("centre").alias("centre"), "n")


@query
def bottom_k_sample(spark, d):
    return series.bottom_k(posts(spark, d).select("tweet_id"), "tweet_id", 500)


@query
def topk_per_group(spark, d):
    return series.first_n(posts(spark, d).select("lang", "tweet_id"), "lang", "tweet_id", 10)


@query
def signal_figure(spark, d):
    f = series.signal_figure(sg.signal_with_intervals(scored(spark, d), 360))
    return f.select(stamp("bucket_start").alias("bucket_start"), "is_break", "signal", "ci_low", "ci_high", "n_tweets", "significant")


@query
def bull_share_figure(spark, d):
    f = series.bull_share_figure(signals(spark, d))
    return f.select(stamp("bucket_start").alias("bucket_start"), *(r6(c).alias(c) for c in ("bull_share", "err_low", "err_high")))


def documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, docs.count()


@query
def tfidf_word(spark, d):
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    tf = vectors.term_frequencies(talk, "id", vectors.word_terms(F.col("text"), list(vectors.EXTRA_STOPS)), "word")
    w = vectors.tfidf(tf, talk.count(), 2, None)
    return w.select("id", "term", "tf", "df", r6("weight").alias("weight"))


@query
def tfidf_char(spark, d):
    items = table(spark, d, "benchmark").select("item_id", "text")
    tf = vectors.term_frequencies(items, "item_id", vectors.char_terms(F.col("text")), "char")
    w = vectors.tfidf(tf, items.count(), 3, None)
    return w.select("id", "term", "tf", "df", r6("weight").alias("weight"))


def document_terms(spark, d):
    docs, n = documents(spark, d)
    return docs, n, vectors.word_terms(F.col("text"), list(vectors.EXTRA_STOPS))


@query
def top_terms(spark, d):
    docs, n, terms = document_terms(spark, d)
    w = vectors.tfidf_of(docs, "doc_id", terms, vectors.vocabulary_of(docs, terms, 2, 20_000), n)
    return vectors.top_terms(w, n).select("term", r6("mean_weight").alias("mean_weight"))


@query
def matrix_density(spark, d):
    docs, n, terms = document_terms(spark, d)
    return vectors.density_of(vectors.vocabulary_of(docs, terms, 2, 20_000), n).select("n_docs", "n_terms", "nnz", r6("density_pct").alias("density_pct"))


@query
def hashed_tf(spark, d):
    docs, _ = documents(spark, d)
    return vectors.hashed_counts(docs, "doc_id", "text")


@query
def nfkc_normalise(spark, d):
    docs, _ = documents(spark, d)
    return cl.normalised(docs, "text").select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query
def slice_plan(spark, d):
    return planner.plan(spark, NOW, 72).select("group", big("start"), big("end"), "priority", "text", "key", big("place"))


@query
def pending_queries(spark, d):
    planned = planner.plan(spark, NOW, 72)
    done = planned.where(F.col("start") % 7 == 0).select("key")
    return planner.pending(planned, done).select("key")


def search_results(spark, d):
    p = posts(spark, d)
    return p.select("tweet_id", F.concat(F.lit("g"), F.col("tweet_id") % 3).alias("group")), p.where("tweet_id % 2 = 0").select("tweet_id", F.lit("g9").alias("group"))


@query
def group_yield(spark, d):
    a, b = search_results(spark, d)
    return planner.group_yield(a.unionByName(b)).select("group", "n", r6("projected").alias("projected"))


@query
def union_distinct(spark, d):
    a, b = search_results(spark, d)
    return planner.union_distinct(a, b).select("tweet_id")


@query
def duplicate_yield(spark, d):
    a, b = search_results(spark, d)
    y = planner.duplicate_yield(a.select("tweet_id", F.lit("all").alias("group")).unionByName(b.select("tweet_id", F.lit("all").alias("group"))))
    return y.select("group", "n", "n_distinct", r6("duplicate_share").alias("duplicate_share"))


def event_stream(spark, d):
    from tideglass.streaming import jobs

    events = jobs.file_stream(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, "events.parquet")
    return events.withColumn("created_at", F.col("ts").cast("timestamp"))


@query
def streaming_buckets(spark, d):
    from tideglass.streaming import jobs

    s = event_stream(spark, d).groupBy(F.window("created_at", "60 minutes")).agg(F.count(F.lit(1)).alias("n_tweets")).select(F.col("window.start").alias("b"), "n_tweets")
    return jobs.run_to_table(s, "streaming_buckets", mode="complete").select(stamp("b").alias("bucket_start"), "n_tweets")


@query
def streaming_histogram(spark, d):
    from tideglass.streaming import jobs

    s = jobs.histogram_counts(event_stream(spark, d), F.col("value"), 20, 0.0, 100.0)
    return jobs.run_to_table(s, "streaming_histogram", mode="complete").select(big("bin"), "n")


@query
def streaming_dedup(spark, d):
    from tideglass.streaming import jobs

    s = jobs.first_within(event_stream(spark, d).select("created_at", F.col("user_id").alias("tweet_id")), late="60 days")
    return jobs.run_to_table(s.select("tweet_id"), "streaming_dedup")


def queries():
    return dict(QUERIES)


def oracle_sql():
    from tideglass.plans import oracles

    return oracles.oracle_sql()
