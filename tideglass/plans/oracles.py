"""DuckDB twins of the registered queries."""

from __future__ import annotations

from tideglass.functions.lexicon import CORPORATE, EARNINGS, EMOJI, LEXICON, LONGEST_FIRST, MECHANICAL, NEGATIONS, PROMO
from tideglass.operators.dedup import PRIME, permutation_seeds
from tideglass.operators.planner import TERM_GROUPS
from tideglass.operators.vectors import EXTRA_STOPS
from tideglass.plans.posts import EMOJI_TEMPLATES, posts_sql, prices_sql, quoted

NOW_EPOCH = 1_706_659_200 - 1_234  # late on 30 January 2024, off any grid
EMOJI_SHOWN = {"rocket": "🚀", "down": "📉", "red": "🔴", "heart": "❤", "fire": "🔥", "up": "📈"}
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(x: str) -> str:
    return STAMP.format(x)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


POSTS = posts_sql()
TERMS = "(" + "|".join(LONGEST_FIRST) + ")"
WEIGHTS = ", ".join(f"({quoted(t)}, {w}::DOUBLE)" for t, w in LEXICON.items())
SOCIAL = r"regexp_replace(regexp_replace(regexp_replace(content, '[#＃]\w+', ' ', 'g'), 'https?://\S+', ' ', 'g'), '@\w+', ' ', 'g')"
SOCIAL_ANY = SOCIAL.replace(r"[#＃]\w+", r"[#＃][\p{L}\p{N}_]+")
SCORED = rf"""lexicon(term, w) AS (VALUES {WEIGHTS}),
bodies AS (SELECT content, body, regexp_extract_all(lower(body), '\b{TERMS}\b', 1) AS m, regexp_split_to_array(lower(body), '\b{TERMS}\b') AS g FROM (SELECT DISTINCT content, {SOCIAL} AS body FROM posts)),
hits AS (SELECT content, i, m[i] AS term, list_filter(regexp_split_to_array(array_to_string(list_transform(range(1, i + 1), lambda j: g[j] || CASE WHEN j < i THEN m[j] ELSE '' END), ''), '\s+'), lambda t: t <> '') AS words
  FROM (SELECT content, m, g, unnest(range(1, len(m) + 1)) AS i FROM bodies)),
terms AS (SELECT content, list(CASE WHEN len(list_filter(words[greatest(len(words) - 2, 1):len(words)], lambda t: trim(t, '.,!?') IN ({listed(NEGATIONS)}))) > 0 THEN -w ELSE w END ORDER BY i) AS ws FROM hits JOIN lexicon USING (term) GROUP BY content),
texts AS (SELECT b.content, list_concat(coalesce(t.ws, []), list_transform(regexp_extract_all(body, '(?i)\b(\d{{4,6}})\s*(ce|pe)\b', 2), lambda x: CASE WHEN lower(x) = 'ce' THEN 0.6::DOUBLE ELSE -0.6::DOUBLE END)) AS s,
  regexp_matches(b.content, '(?i){PROMO}') AS is_promo,
  CASE WHEN regexp_matches(b.content, '(?i)\b(?:{EARNINGS})\b') THEN 'earnings' WHEN regexp_matches(b.content, '(?i)\b(?:{CORPORATE})\b') THEN 'corporate_action' WHEN regexp_matches(b.content, '(?i)\b(?:{MECHANICAL})\b') THEN 'mechanical' ELSE 'discussion' END AS content_class
  FROM bodies b LEFT JOIN terms t ON t.content = b.content),
scores AS (SELECT content, CASE WHEN len(s) = 0 THEN 0.0::DOUBLE ELSE list_reduce(s, lambda x, y: x + y) / len(s) END AS raw, CAST(len(s) AS INTEGER) AS evidence, is_promo, content_class FROM texts)"""
FEATURES = f"""{POSTS},
{SCORED},
features AS (SELECT p.*, CAST(CAST(raw AS FLOAT) AS DOUBLE) AS polarity, evidence, is_promo, content_class,
  CAST(CAST(ln(1 + like_count + 2.0::DOUBLE * retweet_count + 3.0::DOUBLE * reply_count + 3.0::DOUBLE * quote_count) AS FLOAT) AS DOUBLE) AS engagement,
  CAST(CAST(least(ln(1.0::DOUBLE + followers), ln(1000001.0::DOUBLE)) AS FLOAT) AS DOUBLE) AS authority,
  CAST(CAST(least(evidence, 3) / 3.0::DOUBLE * CASE WHEN is_promo THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN content_class IN ('earnings', 'corporate_action') THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN is_retweet THEN 0.7::DOUBLE ELSE 1 END AS FLOAT) AS DOUBLE) AS confidence
  FROM posts p JOIN scores USING (content)),
weighted AS (SELECT f.*, confidence * (1 + engagement / me) * (1 + authority / ma) AS weight FROM features f, (SELECT max(engagement) AS me, max(authority) AS ma FROM features))"""


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k}::DOUBLE / {n})", "1.96::DOUBLE"
    scale = f"(1 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / 2 / {n}) / {scale})"
    half = f"({z} / {scale} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / 4 / {n}::DOUBLE / {n}))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END", f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, {centre} + {half}) END"


def signals_sql(minutes: int) -> str:
    low, high = wilson_sql("b", "dir")
    return f"""{FEATURES},
sums AS (SELECT time_bucket(INTERVAL '{minutes} minutes', created_at) AS bucket_start, count(*) AS n_tweets, count(*) FILTER (evidence > 0) AS n_scoreable, sum(polarity * weight) FILTER (evidence > 0) AS pw, sum(weight) FILTER (evidence > 0) AS w,
  count(*) FILTER (evidence > 0 AND polarity > 0) AS b, count(*) FILTER (evidence > 0 AND polarity <> 0) AS dir, avg(engagement) AS mean_engagement FROM weighted GROUP BY 1),
signals AS (SELECT bucket_start, n_tweets, n_scoreable, n_tweets < 5 OR n_scoreable < 3 AS sparse, CASE WHEN NOT (n_tweets < 5 OR n_scoreable < 3) THEN coalesce(pw / nullif(w, 0), 0) END AS signal,
  CASE WHEN NOT (n_tweets < 5 OR n_scoreable < 3) THEN b::DOUBLE / nullif(dir, 0) END AS bull_share, CASE WHEN NOT (n_tweets < 5 OR n_scoreable < 3) THEN {low} END AS bull_ci_low, CASE WHEN NOT (n_tweets < 5 OR n_scoreable < 3) THEN {high} END AS bull_ci_high, mean_engagement FROM sums)"""


SIGNAL_COLUMNS = f"{stamp('bucket_start')} AS bucket_start, n_tweets, n_scoreable, round(signal, 6) AS signal, round(bull_share, 6) AS bull_share, round(bull_ci_low, 6) AS bull_ci_low, round(bull_ci_high, 6) AS bull_ci_high, round(mean_engagement, 6) AS mean_engagement, sparse"
PRICES = prices_sql()
IST = "({} + INTERVAL '330 minutes')"
ALIGNED = f"""{signals_sql(60)},
{PRICES},
returns AS (SELECT bar_ts, ln(nullif(lead(close, 2) OVER (ORDER BY bar_ts), 0) / nullif(close, 0)) AS fwd_ret FROM prices),
aligned AS (SELECT s.bucket_start, s.signal AS x, r.fwd_ret AS y FROM (SELECT * FROM signals WHERE NOT sparse) s ASOF JOIN (SELECT * FROM returns WHERE fwd_ret IS NOT NULL) r ON s.bucket_start >= r.bar_ts WHERE s.bucket_start - r.bar_ts <= INTERVAL '60 minutes'),
ranks AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM aligned),
rs AS (SELECT count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS s, count(*) FILTER (sign(x) = sign(y)) AS hits FROM ranks)"""


def student_sql(r: str) -> str:
    v = "(n - 2)"
    theta = f"atan(abs({r}) / sqrt(1 - {r} * {r}))"
    c, s = f"cos({theta})", f"sin({theta})"
    even = f"({s} * list_sum(list_transform(range(0, greatest(({v} - 2) // 2 + 1, 1)), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0 * j - 1) / (2.0 * j) * {c} * {c})), 1.0))))"
    odd = f"(2 / pi() * ({theta} + {s} * {c} * list_sum(list_transform(range(0, greatest(({v} - 3) // 2 + 1, 1)), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2.0 * j / (2.0 * j + 1) * {c} * {c})), 1.0)))))"
    return f"CASE WHEN n >= 3 THEN 1 - CASE WHEN {v} % 2 = 1 THEN {odd} ELSE {even} END END"


def raw_ok(i: str) -> str:
    """Which raw lines are clean."""
    return f"{i} % 37 <> 0 AND {i} % 53 <> 0 AND {i} % 41 <> 0 AND {i} % 43 <> 0 AND {i} % 47 <> 0"


NORM = r"trim(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '\s+', ' ', 'g'))"


def shingle_cte(source: str, key: str) -> str:
    return f"""norms AS (SELECT {key} AS id, {NORM} AS norm FROM {source}),
tokens AS (SELECT id, norm, list_filter(string_split(norm, ' '), lambda t: t <> '') AS t FROM norms),
shingles AS (SELECT id, CASE WHEN len(t) < 3 THEN [norm] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) END AS s FROM tokens)"""


def signature_sql() -> str:
    mins = ", ".join(f"CAST(min((h * {a} + {b}) % {PRIME}) AS BIGINT) AS m{i}" for i, (a, b) in enumerate(permutation_seeds(8)))
    return f"{with_(shingle_cte('benchmark', 'item_id'))} SELECT id AS item_id, {mins} FROM (SELECT id, CAST(('0x' || substr(md5(x), 1, 7)) AS BIGINT) AS h FROM (SELECT id, unnest(s) AS x FROM shingles)) GROUP BY id"


LINKS = r"regexp_replace(text, 'https?://\S+|t\.co/\S+', ' ', 'g')"


def word_tf(source: str, key: str) -> str:
    return rf"""tok AS (SELECT {key} AS id, list_filter(regexp_extract_all(lower({LINKS}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains([{listed(EXTRA_STOPS)}], t)) AS t FROM {source}),
each AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
tf AS (SELECT id, term, count(*) AS tf FROM each GROUP BY 1, 2)"""


def weights_sql(source: str, min_df: int, most: int | None = None) -> str:
    ranked = f"QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= {most}" if most else ""
    return f"""vocab AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {min_df} {ranked}),
raw AS (SELECT id, term, tf, df, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS r FROM tf JOIN vocab USING (term)),
weights AS (SELECT id, term, tf, df, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS weight FROM raw)"""


def char_tf() -> str:
    grams = " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))) AS term FROM padded WHERE length(w) >= {n}" for n in (3, 4, 5))
    return rf"""padded AS (SELECT item_id AS id, ' ' || unnest(list_filter(regexp_split_to_array(lower({LINKS}), '\s+'), lambda w: w <> '')) || ' ' AS w FROM benchmark),
each AS ({grams}), tf AS (SELECT id, term, count(*) AS tf FROM each GROUP BY 1, 2)"""


def plan_cte(hours: int) -> str:
    local = "(since + 19800)"
    width = f"CASE WHEN ({local} // 86400 + 3) % 7 >= 5 THEN 120 WHEN {local} % 86400 // 60 >= 555 AND {local} % 86400 // 60 < 930 THEN 30 WHEN {local} % 86400 // 60 >= 420 AND {local} % 86400 // 60 < 1140 THEN 60 ELSE 120 END"
    priority = f"CASE WHEN ({local} // 86400 + 3) % 7 >= 5 THEN 3 WHEN {local} % 86400 // 60 >= 555 AND {local} % 86400 // 60 < 930 THEN 0 WHEN {local} % 86400 // 60 >= 420 AND {local} % 86400 // 60 < 1140 THEN 1 ELSE 2 END"
    groups = ", ".join(f"({i}, {quoted(g)})" for i, g in enumerate(TERM_GROUPS))
    return f"""RECURSIVE walk(since) AS (SELECT {NOW_EPOCH - hours * 3600}::BIGINT UNION ALL SELECT least(since + ({width}) * 60, {NOW_EPOCH}) FROM walk WHERE least(since + ({width}) * 60, {NOW_EPOCH}) < {NOW_EPOCH}),
slices AS (SELECT since AS "start", least(since + ({width}) * 60, {NOW_EPOCH})::BIGINT AS "end", {priority} AS priority FROM walk),
names(ord, "group") AS (VALUES {groups}),
plan AS (SELECT "group", "start", "end", CAST(priority AS INTEGER) AS priority, "group" || ' since_time:' || "start" || ' until_time:' || "end" AS text, "group" || '|' || "start" AS key, row_number() OVER (ORDER BY priority, "start" DESC, ord) AS place FROM slices, names)"""


RESULTS = f"""{POSTS},
a AS (SELECT tweet_id, 'g' || (tweet_id % 3) AS "group" FROM posts),
b AS (SELECT tweet_id, 'g9' AS "group" FROM posts WHERE tweet_id % 2 = 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def oracle_sql() -> dict[str, str]:
    low, high = wilson_sql("k", "n")
    hit_low, hit_high = wilson_sql("hits", "n")
    emoji = ", ".join(f"CAST(least((length(body) - length(replace(body, '{e}', ''))) / {len(e)}, 3) AS INTEGER) AS {n}" for n, e in EMOJI_SHOWN.items())
    assert set(EMOJI_SHOWN.values()) <= set(EMOJI)
    return {
        "bucket_signal": f"{with_(signals_sql(60))} SELECT {SIGNAL_COLUMNS} FROM signals",
        "bucket_signal_quarter_hours": f"{with_(signals_sql(15))} SELECT {SIGNAL_COLUMNS} FROM signals",
        "bucket_counts": f"{with_(POSTS)} SELECT {stamp('b')} AS bucket_start, count(*) AS n_tweets, count(DISTINCT user_id) AS n_users FROM (SELECT time_bucket(INTERVAL '15 minutes', created_at) AS b, user_id FROM posts) GROUP BY b",
        "wilson_intervals": f"{with_(POSTS)} SELECT user_id, n, k, round({low}, 6) AS low, round({high}, 6) AS high FROM (SELECT user_id, count(*) AS n, count(*) FILTER (like_count > 50) AS k FROM posts GROUP BY user_id)",
        "live_span": f"{with_(signals_sql(15))} SELECT {stamp('first_live')} AS first_live, {stamp('last_live')} AS last_live, {stamp(IST.format('first_live'))} AS first_live_ist, n_live FROM (SELECT min(bucket_start) FILTER (NOT sparse) AS first_live, max(bucket_start) FILTER (NOT sparse) AS last_live, count(*) FILTER (NOT sparse) AS n_live FROM signals)",
        "bootstrap_ci": f"""{with_(FEATURES)},
rows AS (SELECT CAST(epoch(time_bucket(INTERVAL '360 minutes', created_at)) AS BIGINT) AS b, polarity, weight, tweet_id FROM weighted WHERE evidence > 0),
placed AS (SELECT b, polarity, weight, row_number() OVER (PARTITION BY b ORDER BY tweet_id) - 1 AS place, count(*) OVER (PARTITION BY b) AS n FROM rows),
picks AS (SELECT b, r, CAST(('0x' || substr(md5('42:' || b || ':' || r || ':' || place), 1, 8)) AS BIGINT) % n AS place FROM placed, range(1000) t(r)),
means AS (SELECT b, r, sum(polarity * weight) / nullif(sum(weight), 0) AS m FROM picks JOIN placed USING (b, place) GROUP BY b, r)
SELECT b, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means WHERE m IS NOT NULL GROUP BY b""",
        "composite_weights": f"{with_(FEATURES)} SELECT tweet_id, round(weight, 6) AS weight FROM weighted",
        "lexicon_score": f"{with_(POSTS, SCORED)} SELECT tweet_id, round(raw, 6) AS polarity, evidence, is_promo FROM posts JOIN scores USING (content)",
        "classify": f"{with_(POSTS, SCORED)} SELECT tweet_id, content_class FROM posts JOIN scores USING (content)",
        "promo_flag": f"{with_(POSTS, SCORED)} SELECT lang, count(*) FILTER (is_promo) AS n_promo, count(*) AS n FROM posts JOIN scores USING (content) GROUP BY lang",
        "emoji_legs": rf"{with_(posts_sql(EMOJI_TEMPLATES))} SELECT tweet_id, {emoji}, CAST(len(regexp_extract_all(body, '(?i)\b(\d{{4,6}})\s*(ce|pe)\b', 2)) AS INTEGER) AS n_legs FROM (SELECT tweet_id, {SOCIAL_ANY} AS body FROM posts)",
        "post_features": f"{with_(FEATURES)} SELECT tweet_id, round(polarity, 6) AS polarity, round(engagement, 6) AS engagement, round(authority, 6) AS authority, round(confidence, 6) AS confidence, evidence, is_promo, content_class FROM features",
        "corpus_summary": f"{with_(FEATURES)} SELECT count(*) AS n_tweets, count(DISTINCT username) AS n_unique_authors, round(avg(CAST(evidence > 0 AS INTEGER)), 6) AS pct_scoreable, round(avg(CAST(is_promo AS INTEGER)), 6) AS pct_promotional, round(avg(polarity), 6) AS mean_polarity FROM features",
        "class_counts": f"{with_(POSTS, SCORED)} SELECT content_class, count(*) AS n FROM posts JOIN scores USING (content) GROUP BY 1",
        "distinct_authors": f"{with_(POSTS)} SELECT lang, count(DISTINCT username) AS n_authors FROM posts GROUP BY lang",
        "mergeable_signal": f"{with_(FEATURES)} SELECT {stamp('b')} AS bucket_start, round(coalesce(sum(polarity * weight) FILTER (evidence > 0) / nullif(sum(weight) FILTER (evidence > 0), 0), 0), 6) AS signal FROM (SELECT *, time_bucket(INTERVAL '60 minutes', created_at) AS b FROM weighted) GROUP BY b",
        "clean_posts": f"""{with_(POSTS)} SELECT tweet_id, {stamp('created_at')} AS created_at, username, user_id, followers, content, CASE WHEN tweet_id % 5 <> 0 THEN lang ELSE 'und' END AS lang, CASE WHEN tweet_id % 3 <> 0 THEN reply_count ELSE 0 END AS reply_count, retweet_count, like_count, quote_count,
  CASE WHEN tweet_id % 2 = 0 THEN 0 ELSE tweet_id * 3 END AS view_count, 'nifty' AS hashtags, CASE WHEN tweet_id % 9 = 0 THEN 'TCS' ELSE '' END AS cashtags, 'ann' AS mentions, tweet_id % 10 = 1 AS is_retweet, tweet_id % 8 = 0 AS is_reply, tweet_id % 7 = 0 AS is_quote, tweet_id % 4 = 0 OR tweet_id % 6 = 0 AS verified, 0::BIGINT AS conversation_id
  FROM posts WHERE {raw_ok('tweet_id')}""",
        "clean_counters": f"""{with_(POSTS)} SELECT count(*) FILTER (tweet_id % 37 = 0 OR tweet_id % 53 <> 0) AS lines, count(*) FILTER (tweet_id % 37 = 0) AS malformed,
  count(*) FILTER (tweet_id % 37 <> 0 AND tweet_id % 53 <> 0 AND NOT ({raw_ok('tweet_id')})) AS unusable, count(*) FILTER ({raw_ok('tweet_id')} AND epoch(created_at) < {NOW_EPOCH - 86400}) AS out_of_window, count(*) FILTER ({raw_ok('tweet_id')} AND epoch(created_at) >= {NOW_EPOCH - 86400}) AS clean FROM posts""",
        "window_filter": f"{with_(POSTS)} SELECT lang, count(*) AS n, {stamp('min(created_at)')} AS first FROM posts WHERE epoch(created_at) >= {NOW_EPOCH - 7 * 86400} GROUP BY lang",
        "partition_columns": f"{with_(POSTS)} SELECT strftime(created_at, '%Y-%m-%d') AS date, strftime(created_at, '%H') AS hour, count(*) AS n FROM posts GROUP BY 1, 2",
        "entity_extract": rf"{with_(POSTS)} SELECT tweet_id, array_to_string(regexp_extract_all(content, '#(\w+)', 1), ',') AS hashtags, array_to_string(regexp_extract_all(content, '\$([A-Za-z]{{1,6}})', 1), ',') AS cashtags, array_to_string(regexp_extract_all(content, '@(\w+)', 1), ',') AS mentions FROM posts",
        "parse_count": """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE CAST(floor(CAST(replace(shown, ',', '') AS DOUBLE) * ([1, 1000, 1000000, 1000000000])[event_id % 5 + 1]) AS BIGINT) END AS n
  FROM (SELECT event_id, (event_id % 900) || CASE WHEN event_id % 2 = 0 THEN '.' || (event_id % 10) WHEN event_id % 3 = 0 THEN ',123' ELSE '' END AS shown FROM events)""",
        "url_parts": "SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS last, split_part(url, '/', 3) AS host FROM pages",
        "permalink_records": rf"{with_(POSTS)} SELECT tweet_id AS id, {stamp('created_at')} AS date, username, 1200::BIGINT AS reply_count, 3::BIGINT AS retweet_count, 0::BIGINT AS like_count, CAST(len(regexp_extract_all(content, '#(\w+)', 1)) AS INTEGER) AS n_hashtags FROM posts",
        "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
        "dedup_stats": "SELECT count(*) AS total, count(*) - count(DISTINCT text) AS exact_dupes, count(DISTINCT text) AS kept FROM documents",
        "shingle_counts": f"{with_(shingle_cte('conversations', '(conv_id, turn)'))} SELECT id[1] AS conv_id, id[2] AS turn, CAST(len(s) AS INTEGER) AS n_shingles FROM shingles",
        "jaccard_pairs": f"""{with_(shingle_cte('documents', 'doc_id'))},
each AS (SELECT id, len(s) AS n, unnest(s) AS x FROM shingles), common AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM common WHERE c::DOUBLE / (na + nb - c) >= 0.5""",
        "minhash_signature": signature_sql(),
        "forward_returns": f"{with_(PRICES)} SELECT {stamp('bar_ts')} AS bar_ts, round(close, 6) AS close, round(ln(nullif(lead(close, 2) OVER (ORDER BY bar_ts), 0) / nullif(close, 0)), 6) AS fwd_ret FROM prices",
        "asof_join": f"{with_(PRICES)} SELECT e.event_id, round(CASE WHEN e.ts - p.bar_ts <= INTERVAL '900 seconds' THEN p.close END, 6) AS close FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN prices p ON e.ts >= p.bar_ts",
        "correlation": f"{with_(ALIGNED)} SELECT n, round(r, 6) AS pearson_r, round({student_sql('r')}, 6) AS pearson_p, round(s, 6) AS spearman_r, round({student_sql('s')}, 6) AS spearman_p FROM rs",
        "hit_rate": f"{with_(ALIGNED)} SELECT n, hits, round(hits::DOUBLE / n, 6) AS hit_rate, round({hit_low}, 6) AS hit_low, round({hit_high}, 6) AS hit_high FROM rs",
        "market_hours": f"{with_(POSTS)} SELECT tweet_id, isodow(t) < 6 AND hour(t) * 60 + minute(t) BETWEEN 555 AND 930 AS open FROM (SELECT tweet_id, created_at + INTERVAL '330 minutes' AS t FROM posts)",
        "average_rank": f"{with_(POSTS)} SELECT tweet_id, round(rank() OVER (PARTITION BY lang ORDER BY like_count) + (count(*) OVER (PARTITION BY lang, like_count) - 1) / 2.0::DOUBLE, 6) AS rank FROM posts",
        "gap_breaks": f"""{with_(signals_sql(15))}, live AS (SELECT bucket_start, signal, epoch(bucket_start) - epoch(lag(bucket_start) OVER (ORDER BY bucket_start)) AS gap FROM signals WHERE NOT sparse), med AS (SELECT median(gap) AS m FROM live)
SELECT {stamp('bucket_start')} AS bucket_start, false AS is_break, round(signal, 6) AS signal FROM live UNION ALL SELECT {stamp('bucket_start')}, true, NULL FROM live, med WHERE m > 0 AND gap > 1.5 * m""",
        "every_nth": f"{with_(PRICES)} SELECT {stamp('bar_ts')} AS bar_ts, round(close, 6) AS close FROM (SELECT *, row_number() OVER (ORDER BY bar_ts) - 1 AS i FROM prices) WHERE i % 7 = 0",
        "histogram": "SELECT b.bin, round((b.bin - 1) * 1000.0::DOUBLE, 6) AS lo, round(b.bin * 1000.0::DOUBLE, 6) AS hi, coalesce(n, 0)::BIGINT AS n FROM range(1, 51) b(bin) LEFT JOIN (SELECT least(CAST(floor(least(greatest(l_extendedprice, 0), 50000) / 1000.0) AS BIGINT) + 1, 50) AS bin, count(*) AS n FROM lineitem GROUP BY 1) c ON c.bin = b.bin",
        "engagement_histogram": f"{with_(POSTS)} SELECT b.bin, round(b.bin * 0.25::DOUBLE - 0.125, 6) AS centre, coalesce(n, 0)::BIGINT AS n FROM range(1, 41) b(bin) LEFT JOIN (SELECT least(CAST(floor(least(ln(1 + like_count + 2.0::DOUBLE * retweet_count + 3.0::DOUBLE * reply_count), 10) / 0.25::DOUBLE) AS BIGINT) + 1, 40) AS bin, count(*) AS n FROM posts GROUP BY 1) c ON c.bin = b.bin",
        "bottom_k_sample": f"{with_(POSTS)} SELECT tweet_id FROM posts ORDER BY md5('42:' || tweet_id), tweet_id LIMIT 500",
        "topk_per_group": f"{with_(POSTS)} SELECT lang, tweet_id FROM posts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY tweet_id) <= 10",
        "bull_share_figure": f"{with_(signals_sql(60))} SELECT {stamp('bucket_start')} AS bucket_start, round(bull_share, 6) AS bull_share, round(bull_share - bull_ci_low, 6) AS err_low, round(bull_ci_high - bull_share, 6) AS err_high FROM signals WHERE NOT sparse AND bull_share IS NOT NULL",
        "tfidf_word": f"{with_(word_tf('conversations', 'conv_id * 1000 + turn'), weights_sql('conversations', 2))} SELECT id, term, tf, df, round(weight, 6) AS weight FROM weights",
        "tfidf_char": f"{with_(char_tf(), weights_sql('benchmark', 3))} SELECT id, term, tf, df, round(weight, 6) AS weight FROM weights",
        "top_terms": f"{with_(word_tf('documents', 'doc_id'), weights_sql('documents', 2, 20000))} SELECT term, round(m, 6) AS mean_weight FROM (SELECT term, w / d AS m FROM (SELECT term, sum(weight) AS w FROM weights GROUP BY term), (SELECT count(*) AS d FROM documents)) ORDER BY round(m, 9) DESC, term LIMIT 25",
        "matrix_density": f"{with_(word_tf('documents', 'doc_id'), weights_sql('documents', 2, 20000))} SELECT d AS n_docs, t AS n_terms, n AS nnz, round(100.0::DOUBLE * n / (t * d), 6) AS density_pct FROM (SELECT count(DISTINCT term) AS t, count(*) AS n FROM weights), (SELECT count(*) AS d FROM documents)",
        "slice_plan": f'WITH {plan_cte(72)} SELECT "group", "start", "end", priority, text, key, place FROM plan',
        "pending_queries": f'WITH {plan_cte(72)} SELECT key FROM plan WHERE "start" % 7 <> 0',
        "group_yield": f'{with_(RESULTS)} SELECT "group", count(*) AS n, round(count(*) * 31.2::DOUBLE, 6) AS projected FROM u GROUP BY 1',
        "union_distinct": f"{with_(RESULTS)} SELECT DISTINCT tweet_id FROM u",
        "duplicate_yield": f"{with_(RESULTS)} SELECT 'all' AS \"group\", count(*) AS n, count(DISTINCT tweet_id) AS n_distinct, round(1 - count(DISTINCT tweet_id)::DOUBLE / count(*), 6) AS duplicate_share FROM u",
        "streaming_buckets": f"SELECT {stamp('b')} AS bucket_start, count(*) AS n_tweets FROM (SELECT time_bucket(INTERVAL '60 minutes', ts) AS b FROM events) GROUP BY b",
        "streaming_histogram": "SELECT least(CAST(floor(least(greatest(value, 0), 100) / 5.0) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
        "streaming_dedup": "SELECT DISTINCT user_id AS tweet_id FROM events",
    }
