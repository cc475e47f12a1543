"""The same results in DuckDB SQL, over the same tables."""

from __future__ import annotations

from tickertone.schemas import FALLBACK_MODEL, NO_HEADLINE_MODEL, PRIMARY_MODEL
from tickertone.sources.registry import FEEDS
from workload.tables import RESPONSE_VARIANTS, STORE_HOURS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CLOCK = "clock AS (SELECT max(ts) + INTERVAL 5 MINUTE AS as_of FROM events)"

ARTICLES = """
articles AS (
  SELECT e.event_id AS seq,
    CASE WHEN e.event_id % 97 = 0 THEN NULL WHEN e.value < 1 THEN ' '
         ELSE split_part(d.text, chr(10), 1) END AS title,
    CASE WHEN e.event_type = 'signup' THEN '' ELSE substr(d.text, 1, 6000) END AS text,
    CASE WHEN e.event_id % 11 = 0 THEN 'No Link Provided'
         ELSE 'https://' || d.source || '.example/' || e.event_id END AS link,
    d.source AS source,
    CASE d.lang WHEN 'en' THEN 'International' WHEN 'de' THEN NULL ELSE 'Nepali' END AS region,
    CASE WHEN e.event_type = 'error' THEN NULL ELSE e.ts END AS published_at,
    e.ts + INTERVAL 5 MINUTE AS ingested_at
  FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS d_id FROM events) e
  JOIN documents d ON d.doc_id = e.d_id
)"""

STORED = f"""
stored AS (SELECT * FROM articles, clock WHERE ingested_at < as_of - INTERVAL {STORE_HOURS} HOUR),
arriving AS (SELECT articles.* FROM articles, clock WHERE ingested_at >= as_of - INTERVAL {STORE_HOURS} HOUR)"""

FRESH = """
fresh AS (
  SELECT a.* EXCLUDE (rn)
  FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY seq) AS rn FROM arriving) a
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.title IS NOT DISTINCT FROM a.title)
)"""

SCORED = """
scored AS (
  SELECT a.*,
    CASE WHEN blank THEN 'Unscored' WHEN sc >= 20 THEN 'Positive' WHEN sc <= -20 THEN 'Negative'
         ELSE 'Neutral' END AS sentiment,
    CASE WHEN blank THEN NULL ELSE CAST(sc AS DOUBLE) END AS sentiment_score
  FROM (SELECT *, trim(coalesce(title, '')) = '' AS blank,
          (length(trim(title)) * 37 + (length(title) - length(replace(title, 'e', ''))) * 53) % 201 - 100 AS sc
        FROM {source}) a
)"""

SAMPLE = """
feeds(feed) AS (VALUES ('International'), ('Nepali')),
shown AS (
  SELECT *, coalesce(region, 'International') AS feed FROM scored
),
sample AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY feed ORDER BY published_at DESC NULLS LAST, seq DESC) AS place
    FROM shown WHERE feed IN ('International', 'Nepali')) x
  WHERE place <= 500
)"""


def batches(source: str) -> str:
    return f"""
batches AS (
  SELECT seq, region_key, headline, CAST(place // 5 AS BIGINT) AS batch_no, CAST(place % 5 + 1 AS INTEGER) AS item_id
  FROM (
    SELECT seq, trim(coalesce(region, '')) AS region_key, trim(title) AS headline,
      row_number() OVER (PARTITION BY trim(coalesce(region, '')) ORDER BY seq) - 1 AS place
    FROM {source} WHERE trim(coalesce(title, '')) <> '') y
)"""


REQUESTS = """
requests AS (
  SELECT region_key, batch_no, list(headline ORDER BY item_id) AS headlines, count(*) AS n
  FROM batches GROUP BY ALL
)"""

HEADLINE_SCORE = "(length(headline) * 37 + (length(headline) - length(replace(headline, 'e', ''))) * 53) % 201 - 100"

RESPONSES = f"""
responses AS (
  SELECT *, CAST(batch_no % {RESPONSE_VARIANTS} AS INTEGER) AS variant FROM requests
),
judged AS (SELECT *, variant IN (0, 1) OR (variant = 3 AND n = 1) AS valid FROM responses)"""


def cleaned(expr: str) -> str:
    """Markup out, the entities of the test pages decoded (their semicolon may be cut off), spaces collapsed."""
    text = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return f"trim(regexp_replace({text}, '[\\s\\x0b]+', ' ', 'g'))"


def with_views(*views: str, select: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select


def from_sample(select: str) -> str:
    return with_views(CLOCK, ARTICLES, SCORED.format(source="articles"), SAMPLE, select=select)


def from_scored(select: str) -> str:
    return with_views(
        CLOCK, ARTICLES, SCORED.format(source="articles"),
        "feeds(feed) AS (VALUES ('International'), ('Nepali'))", select=select,
    )


def from_fresh(*views: str, select: str) -> str:
    return with_views(CLOCK, ARTICLES, STORED, FRESH, *views, select=select)


def whole_minutes(statement: str) -> str:
    """The same with the clock at its whole minute."""
    return statement.replace(CLOCK, "clock AS (SELECT date_trunc('minute', max(ts) + INTERVAL 5 MINUTE) AS as_of FROM events)")


def grid(unit: str, periods: int, pattern: str, source: str, by_feed: bool) -> str:
    feed, same = ("f.feed, ", "c.feed = f.feed AND ") if by_feed else ("", "")
    return f"""
SELECT {feed}g.bucket, strftime(g.bucket, '{pattern}') AS period, l.sentiment, CAST(coalesce(c.n, 0) AS BIGINT) AS stories
FROM (SELECT date_trunc('{unit}', as_of + INTERVAL 345 MINUTE) - to_{unit}s(CAST(i AS INTEGER)) AS bucket
      FROM clock, range({periods}) r(i)) g
CROSS JOIN (VALUES ('Positive'), ('Neutral'), ('Negative')) l(sentiment)
{"CROSS JOIN feeds f" if by_feed else ""}
LEFT JOIN (SELECT {"feed, " if by_feed else ""}CAST(date_trunc('{unit}', published_at + INTERVAL 345 MINUTE) AS TIMESTAMP) AS bucket,
             sentiment, count(*) AS n FROM {source} WHERE published_at IS NOT NULL GROUP BY ALL) c
  ON {same}c.bucket = g.bucket AND c.sentiment = l.sentiment"""


ROLLING = """
SELECT f.feed, avg(sentiment_score) AS avg_24h, count(sentiment_score) AS count_24h,
  sum(sentiment_score) FILTER (published_at >= as_of - INTERVAL 60 MINUTE)
    / nullif(count(sentiment_score) FILTER (published_at >= as_of - INTERVAL 60 MINUTE), 0) AS avg_60m,
  count(sentiment_score) FILTER (published_at >= as_of - INTERVAL 60 MINUTE) AS count_60m
FROM feeds f LEFT JOIN (
  SELECT coalesce(region, 'International') AS feed, published_at, sentiment_score, as_of
  FROM scored, clock
  WHERE published_at >= as_of - INTERVAL 24 HOUR AND published_at < as_of AND sentiment_score IS NOT NULL) d USING (feed)
GROUP BY f.feed"""

RATE = """
SELECT f.feed, count(seq) AS recent, count(seq) / 60.0::DOUBLE AS per_minute
FROM feeds f LEFT JOIN (
  SELECT coalesce(region, 'International') AS feed, seq FROM scored, clock
  WHERE ingested_at >= as_of - INTERVAL 1 HOUR) r USING (feed)
GROUP BY f.feed"""

COUNTS = """
SELECT feed, count(*) FILTER (coalesce(region, 'International') = feed) AS records, count(*) AS all_records
FROM feeds, scored GROUP BY feed"""

COVERAGE = """
SELECT feed, count(*) AS sample_size, avg(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1.0::DOUBLE ELSE 0 END) AS text_coverage,
  avg(CASE WHEN sentiment_score IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS scoring_coverage, avg(sentiment_score) AS mean_score
FROM sample GROUP BY feed"""

FEED_ENTRIES = """
entries AS (
  SELECT 'https://feeds.example/' || (doc_id // 20) AS url, (doc_id // 20) % 5 = 0 AS malformed,
    CAST(doc_id % 20 AS INTEGER) AS entry_no,
    CASE WHEN lang <> 'es' THEN split_part(text, chr(10), 1) END AS title,
    CASE WHEN doc_id % 9 = 0 THEN 'urn:doc:' ELSE 'https://feeds.example/' END || doc_id AS link,
    trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS summary
  FROM documents
)"""

REGISTRY = "registry(place, url, source, region) AS (VALUES " + ", ".join(
    f"({i}, {quoted(url)}, {quoted(source)}, {quoted(region)})" for i, (url, source, region) in enumerate(FEEDS)
) + ")"

ANALYSIS = f"""
  sentiment, sentiment_score, CAST(NULL AS DOUBLE) AS sentiment_confidence,
  CASE WHEN sentiment = 'Unscored' THEN 'Unknown' ELSE 'English' END AS sentiment_language,
  CASE WHEN sentiment = 'Unscored' THEN '{NO_HEADLINE_MODEL}' ELSE '{PRIMARY_MODEL}' END AS sentiment_model"""


# What a request must say, stated here and not taken from the package.
SYSTEM = "You score news headlines. Reply with the results object only, as JSON."
NEPALI_SYSTEM = "You score news headlines. Reply with the results object only, as JSON. Expect Devanagari, romanised Nepali and English side by side."
SCALE = "Use whole numbers between -100 (bad news) and 100 (good news); anything within 19 of zero reads as neutral. "
LIMITS = "The headline is all you know: leave the story behind it out. "
ANSWER = 'Return {"results":[{"id":1,"score":0}]} and list every id once.\nHeadlines:\n'
USER = f"Score the tone of each headline below. {SCALE}{LIMITS}{ANSWER}"
NEPALI_USER = (
    f"Score the news from Nepal below by what it says; a headline scores the same in whichever script it is written. {SCALE}"
    "Ask first whether the headline reports a change for readers in Nepal. Without one, score 0. With one, "
    "choose the sign, then the size: up to 40 if it touches a few readers or is easily undone, more if it "
    f"touches many or lasts. {LIMITS}{ANSWER}"
)
PRIMARY_SCHEMA = (
    '{"type":"object","properties":{"results":{"type":"array","items":{"type":"object","properties":'
    '{"id":{"type":"integer"},"score":{"type":"integer","minimum":-100,"maximum":100}},"required":["id","score"]}}},"required":["results"]}'
)
FALLBACK_SCHEMA = (
    '{"type":"OBJECT","properties":{"results":{"type":"ARRAY","items":{"type":"OBJECT","properties":'
    '{"id":{"type":"INTEGER"},"score":{"type":"INTEGER","minimum":-100,"maximum":100}},"required":["id","score"]}}},"required":["results"]}'
)


def payload_sql() -> str:
    return f"""
SELECT region_key, batch_no, CAST(n AS INTEGER) AS headline_count, system_text, user_text, credential_suffix,
  '{{"messages":[{{"role":"system","content":' || to_json(system_text) || '}},{{"role":"user","content":' || to_json(user_text)
    || '}}],"response_format":{{"type":"json_schema","json_schema":' || {quoted(PRIMARY_SCHEMA)}
    || '}},"temperature":0,"max_tokens":' || greatest(128, 64 * n) || '}}' AS primary_payload,
  '{{"systemInstruction":{{"parts":[{{"text":' || to_json(system_text) || '}}]}},"contents":[{{"parts":[{{"text":' || to_json(user_text)
    || '}}]}}],"generationConfig":{{"temperature":0,"maxOutputTokens":' || greatest(256, 64 * n)
    || ',"responseMimeType":"application/json","responseSchema":' || {quoted(FALLBACK_SCHEMA)} || '}}}}' AS fallback_payload
FROM (
  SELECT *, lower(region_key) = 'nepali' AS nepali,
    CASE WHEN nepali THEN {quoted(NEPALI_SYSTEM)} ELSE {quoted(SYSTEM)} END AS system_text,
    CASE WHEN nepali THEN {quoted(NEPALI_USER)} ELSE {quoted(USER)} END
      || to_json(list_transform(headlines, lambda h, i: {{'id': i, 'headline': h}})) AS user_text,
    CASE WHEN nepali THEN '_NEPALI' ELSE '' END AS credential_suffix
  FROM requests) r"""


def statements() -> dict[str, str]:
    fresh_batches, all_batches = batches("fresh"), batches("articles")
    page_title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    return {
        "feed_registry_counts": "SELECT r_name AS region, count(*) AS feeds FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "feed_entries": with_views(FEED_ENTRIES, select="SELECT * FROM entries"),
        "feed_recovery": with_views(
            FEED_ENTRIES,
            select="""SELECT url, malformed, title, link FROM entries
WHERE NOT malformed OR (trim(coalesce(title, '')) <> '' AND link LIKE 'http%://%')""",
        ),
        "feed_health": with_views(
            FEED_ENTRIES,
            select="""SELECT 'https://feeds.example/' || feed_no AS url, feed_no % 5 = 0 OR feed_no % 7 IN (1, 3, 4) AS malformed,
  CASE feed_no % 7 WHEN 4 THEN 0 WHEN 1 THEN n + 1 WHEN 2 THEN n + 1 ELSE n END AS found,
  CASE WHEN feed_no % 7 = 4 THEN 0 WHEN feed_no % 7 = 2 THEN CASE WHEN feed_no % 5 = 0 THEN usable ELSE n END + 1
       WHEN feed_no % 5 = 0 OR feed_no % 7 IN (1, 3) THEN usable ELSE n END AS kept
FROM (SELECT CAST(split_part(url, '/', 4) AS BIGINT) AS feed_no, count(*) AS n,
        count(*) FILTER (trim(coalesce(title, '')) <> '' AND link LIKE 'http%://%') AS usable
      FROM entries GROUP BY ALL) f""",
        ),
        "stored_title_lookup": with_views(
            CLOCK, ARTICLES, STORED,
            select="SELECT DISTINCT s.title FROM stored s WHERE EXISTS (SELECT 1 FROM arriving a WHERE a.title IS NOT DISTINCT FROM s.title)",
        ),
        "article_json_roundtrip": with_views(
            ARTICLES,
            select="""SELECT title, text, link, source, region, CAST(date_trunc('second', published_at) AS TIMESTAMP) AS published_at,
  CAST(date_trunc('second', ingested_at) AS TIMESTAMP) AS ingested_at FROM articles""",
        ),
        "batch_score_report": with_views(
            ARTICLES, SCORED.format(source="articles"),
            select=f"""SELECT seq, to_json({{'title': title, 'text': text, 'region': region, 'sentiment': sentiment,
  'sentiment_score': sentiment_score, 'sentiment_confidence': sentiment_confidence,
  'sentiment_language': sentiment_language, 'sentiment_model': sentiment_model}})::VARCHAR AS value
FROM (SELECT seq, title, text, region, {ANALYSIS} FROM scored) s""",
        ),
        "article_decode": with_views(
            ARTICLES,
            select="""SELECT seq,
  CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 17 = 0 THEN seq::VARCHAR ELSE title END AS title,
  CASE WHEN seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0 THEN NULL ELSE text END AS text,
  CASE WHEN seq % 13 = 0 OR seq % 17 = 0 THEN NULL ELSE link END AS link,
  CASE WHEN seq % 13 = 0 OR seq % 17 = 0 THEN NULL ELSE source END AS source,
  CASE WHEN seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0 THEN NULL ELSE region END AS region,
  CASE WHEN seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0 THEN NULL ELSE CAST(date_trunc('second', published_at) AS TIMESTAMP) END AS published_at,
  CASE WHEN seq % 13 = 0 OR seq % 17 = 0 OR seq % 19 = 0 THEN NULL ELSE CAST(date_trunc('second', ingested_at) AS TIMESTAMP) END AS ingested_at
FROM articles""",
        ),
        "clean_text": f"SELECT page_id, {cleaned('html')} AS text FROM pages",
        "excerpt_cap": f"SELECT doc_id, substr(t, 1, 6000) AS text, CAST(length(substr(t, 1, 6000)) AS BIGINT) AS chars FROM (SELECT doc_id, {cleaned('text')} AS t FROM documents) d",
        "article_tagged": with_views(
            REGISTRY,
            select=f"SELECT page_id, r.url, r.source, r.region FROM pages JOIN registry r ON r.place = page_id % {len(FEEDS)}",
        ),
        "article_build": with_views(
            CLOCK, REGISTRY,
            select=f"""SELECT page_id, trim({page_title}) AS title,
  CASE WHEN page_id % 4 = 3 THEN '' ELSE substr({cleaned('html')}, 1, 6000) END AS text,
  CASE WHEN page_id % 6 <> 5 THEN p.url ELSE 'No Link Provided' END AS link, r.source, r.region,
  CASE WHEN page_id % 3 = 0 THEN moment ELSE moment - INTERVAL 345 MINUTE END AS published_at, as_of AS ingested_at
FROM (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id % 1000 AS INTEGER)) AS moment FROM pages) p
JOIN registry r ON r.place = page_id % {len(FEEDS)}, clock
WHERE page_id % 10 <> 7""",
        ),
        "script_language": "SELECT doc_id, CASE WHEN regexp_matches(text, '[À-ÿ]') THEN 'Accented' ELSE 'Plain' END AS language FROM documents",
        "first_occurrence": with_views(
            ARTICLES,
            select="""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY seq) AS rn FROM articles) a WHERE rn = 1""",
        ),
        "new_articles": from_fresh(select="SELECT * FROM fresh"),
        "score_batches": from_fresh(fresh_batches, select="SELECT seq, region_key, headline, batch_no, item_id FROM batches"),
        "score_batches_all": with_views(ARTICLES, all_batches, select="SELECT seq, region_key, headline, batch_no, item_id FROM batches"),
        "score_requests": from_fresh(fresh_batches, REQUESTS, select=payload_sql()),
        "unscored_articles": with_views(
            ARTICLES, SCORED.format(source="articles"),
            select=f"SELECT seq, title, text, link, source, region, published_at, ingested_at, {ANALYSIS} FROM scored WHERE sentiment = 'Unscored'",
        ),
        "scored_articles": with_views(
            ARTICLES, SCORED.format(source="articles"),
            select=f"SELECT seq, title, text, link, source, region, published_at, ingested_at, {ANALYSIS} FROM scored",
        ),
        "sentiment_labels": from_fresh(
            SCORED.format(source="fresh"), select="SELECT sentiment, count(*) AS stories FROM scored GROUP BY sentiment"
        ),
        "response_extract": from_fresh(
            fresh_batches, REQUESTS, RESPONSES,
            select=f"""SELECT region_key, batch_no,
  CASE WHEN batch_no % 5 IN (2, 3) OR (batch_no % 5 = 1 AND variant = 9) THEN NULL
       WHEN variant = 9 THEN substr(body, 1, length(body) - 2) ELSE body END AS primary_text,
  CASE WHEN batch_no % 7 <> 0 THEN '{{"results":[' || array_to_string(
    list_transform(headlines, lambda headline, i: '{{"score":' || ({HEADLINE_SCORE}) || ',"id":' || i || '}}'), ',') || ']}}' END AS fallback_text
FROM (
  SELECT *, CASE WHEN variant = 11 THEN '{{"results":{{"id":1,"score":0}}}}' WHEN variant = 10 THEN listed
                 ELSE '{{"results":' || listed || '}}' END AS body
  FROM (
    SELECT *, '[' || array_to_string(CASE variant WHEN 1 THEN list_reverse(items) WHEN 2 THEN items[1:n - 1]
        WHEN 12 THEN list_append(items, 'null') ELSE items END, ',') || ']' AS listed
    FROM (
      SELECT *, list_transform(headlines, lambda headline, i: '{{"id":' || CASE variant WHEN 3 THEN 1 WHEN 4 THEN i - 1 ELSE i END
          || ',"score":' || CASE variant WHEN 5 THEN '101' WHEN 6 THEN '10.5' WHEN 7 THEN 'true' WHEN 8 THEN '"7"'
             WHEN 13 THEN '99999999999' ELSE ({HEADLINE_SCORE})::VARCHAR END || '}}') AS items
      FROM responses) a) b) c""",
        ),
        "response_validation": from_fresh(
            fresh_batches, REQUESTS, RESPONSES, select="SELECT region_key, batch_no, variant, valid FROM judged"
        ),
        "response_mapping": from_fresh(
            fresh_batches, REQUESTS, RESPONSES,
            select=f"""SELECT region_key, batch_no, item_id, seq, headline, CAST(sc AS INTEGER) AS score,
  CASE WHEN sc >= 20 THEN 'Positive' WHEN sc <= -20 THEN 'Negative' ELSE 'Neutral' END AS sentiment
FROM (SELECT b.*, {HEADLINE_SCORE} AS sc FROM batches b JOIN judged USING (region_key, batch_no) WHERE valid) s""",
        ),
        "scorer_fallback": from_fresh(
            fresh_batches, REQUESTS, RESPONSES,
            select=f"""SELECT region_key, batch_no,
  CASE WHEN first THEN '{PRIMARY_MODEL}' WHEN second THEN '{FALLBACK_MODEL}' END AS sentiment_model,
  CAST(CASE WHEN first OR second THEN n ELSE 0 END AS BIGINT) AS scores
FROM (SELECT *, valid AND batch_no % 5 IN (0, 1, 4) AS first, batch_no % 7 <> 0 AS second FROM judged) j""",
        ),
        "region_counts": from_scored(COUNTS),
        "ingest_rate": from_scored(RATE),
        "rolling_sentiment": from_scored(ROLLING),
        "newest_articles": from_sample(
            "SELECT seq, title, link, source, region, sentiment, sentiment_score, text, published_at, feed FROM sample"
        ),
        "normalized_articles": from_scored(
            """SELECT seq, coalesce(title, '') AS title, '' AS link, '' AS source,
  CASE WHEN seq % 3 = 0 THEN 'International' ELSE coalesce(region, 'International') END AS region, sentiment,
  CASE WHEN seq % 5 = 0 THEN NULL ELSE sentiment_score END AS sentiment_score, text, published_at FROM scored"""
        ),
        "story_feed": from_sample(
            """SELECT seq, CASE WHEN coalesce(title, '') = '' THEN 'Untitled story' ELSE title END AS headline,
  CASE WHEN trim(source) = '' THEN 'Unknown source' ELSE trim(source) END AS source, upper(sentiment) AS label,
  CASE WHEN sentiment IN ('Positive', 'Neutral', 'Negative') THEN lower(sentiment) ELSE 'other' END AS label_class,
  coalesce(strftime(published_at + INTERVAL 345 MINUTE, '%d %b %Y · %I:%M %p'), 'Published time unavailable') AS published,
  CASE WHEN link LIKE 'http%://%' THEN link END AS link, sentiment_score, feed
FROM sample WHERE place <= 30"""
        ),
        "sentiment_mix": from_sample("SELECT feed, sentiment, count(*) AS stories FROM sample GROUP BY ALL"),
        "source_counts": from_sample("SELECT feed, source, count(*) AS stories FROM sample GROUP BY ALL"),
        "coverage_metrics": from_sample(COVERAGE),
        "hourly_sentiment": from_sample(grid("hour", 24, "%d %b %I %p", "sample", True)),
        "daily_sentiment": from_sample(grid("day", 7, "%a %d %b", "sample", True)),
        "hourly_sentiment_store": from_scored(grid("hour", 24, "%d %b %I %p", "scored", False)),
        "daily_sentiment_store": from_scored(grid("day", 7, "%a %d %b", "scored", False)),
        "region_overview": from_sample(
            f"SELECT * FROM ({COUNTS}) JOIN ({RATE}) USING (feed) JOIN ({ROLLING}) USING (feed) JOIN ({COVERAGE}) USING (feed)"
        ),
        "stream_scored_store": with_views(
            ARTICLES, SCORED.format(source="(SELECT DISTINCT title FROM articles)"),
            select=f"SELECT title, {ANALYSIS} FROM scored",
        ).replace("CAST(NULL AS DOUBLE) AS sentiment_confidence,", ""),
        "kept_overview": whole_minutes(
            from_sample(f"SELECT * FROM ({COUNTS}) JOIN ({RATE}) USING (feed) JOIN ({ROLLING}) USING (feed) JOIN ({COVERAGE}) USING (feed)")
        ),
        "kept_hourly_sentiment": whole_minutes(from_scored(grid("hour", 24, "%d %b %I %p", "scored", False))),
        "kept_daily_sentiment": whole_minutes(from_scored(grid("day", 7, "%a %d %b", "scored", False))),
        "kept_newest_articles": from_sample(
            "SELECT seq, title, link, source, region, sentiment, sentiment_score, text, published_at, feed FROM sample"
        ),
        "indexed_title_lookup": with_views(
            CLOCK, ARTICLES, STORED,
            select="SELECT DISTINCT s.title FROM stored s WHERE EXISTS (SELECT 1 FROM arriving a WHERE a.title IS NOT DISTINCT FROM s.title)",
        ),
        "stream_title_dedup": with_views(ARTICLES, select="SELECT DISTINCT title FROM articles"),
        "stream_hourly_counts": from_scored(
            """SELECT date_trunc('hour', published_at + INTERVAL 345 MINUTE) AS bucket, sentiment, count(*) AS stories
  FROM scored WHERE published_at IS NOT NULL GROUP BY ALL"""
        ),
    }
