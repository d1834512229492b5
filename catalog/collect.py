"""Sources, collection and gating (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import params as P
from catalog.adapter import (
    ARTICLES, articles, day_text, labelled_articles, q, sql_rejected, sql_replace, sql_strip,
    sql_strip_html, sql_unescape, sql_words, stemmed, table, texts, with_ctes, LABELLED, STEMMED,
)
from catalog.registry import query
from wartaframe.functions import dates
from wartaframe.functions import fixed_values as fixed
from wartaframe.functions import text as tx
from wartaframe.operators import collect, dedup
from wartaframe.session import checkpointed
from wartaframe.sources import feed, tables

START, END = dates.month_period(P.YEAR, P.MONTH)


def dated(spark, sf_dir):
    return articles(spark, sf_dir).withColumn("day", dates.published_date(F.col("tanggal")))


@query(
    "a1_month_period",
    with_ctes(ARTICLES)
    + "SELECT seq, CAST(day AS VARCHAR) AS day FROM articles WHERE day >= DATE '2024-01-01' AND day < DATE '2024-02-01'",
)
def month_period(spark, sf_dir):
    items = dated(spark, sf_dir)
    return items.filter(dates.in_period(F.col("day"), START, END)).select("seq", day_text("day").alias("day"))


@query(
    "a1_event_period",
    """SELECT event_type, count(*) AS n, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day,
  CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day FROM events
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY event_type""",
)
def event_period(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(dates.in_period(F.col("ts"), START, END))
    day = F.to_date("ts")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(day).cast("string").alias("first_day"),
        F.max(day).cast("string").alias("last_day"),
    )


@query(
    "a2_week_windows",
    with_ctes(
        ARTICLES,
        """starts AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 7 DAY))::DATE AS win_start),
windows AS (SELECT ((win_start - DATE '2024-01-01') // 7)::INTEGER AS win, win_start,
  least(win_start + 7, DATE '2024-02-01') AS win_end FROM starts)""",
    )
    + """SELECT win, CAST(win_start AS VARCHAR) AS win_start, CAST(win_end AS VARCHAR) AS win_end, count(seq) AS n
FROM windows LEFT JOIN articles ON day >= win_start AND day < win_end GROUP BY ALL""",
)
def week_windows(spark, sf_dir):
    counts = (
        collect.with_window(dated(spark, sf_dir), F.col("day"), START, END)
        .groupBy("win")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return collect.month_windows(spark, START, END).join(counts, "win", "left").select(
        "win", day_text("win_start").alias("win_start"), day_text("win_end").alias("win_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


@query(
    "a3_feed_items",
    with_ctes(ARTICLES)
    + """SELECT seq, tanggal, CASE WHEN seq % 7 = 0 THEN '' ELSE judul END AS judul, content, url,
  CASE WHEN seq % 11 = 0 THEN '' ELSE source END AS source FROM articles""",
)
def feed_items(spark, sf_dir):
    source = F.when(F.col("seq") % 11 != 0, F.struct(F.col("source").alias("title")))
    items = articles(spark, sf_dir).select(
        "seq",
        F.col("tanggal").alias("published"),
        F.when(F.col("seq") % 7 != 0, F.col("judul")).alias("title"),
        F.col("content").alias("description"),
        F.col("url").alias("link"),
        source.alias("source"),
    )
    return feed.feed_articles(items)


@query(
    "a4_keyword_filter",
    with_ctes(ARTICLES)
    + "SELECT seq FROM articles WHERE "
    + " AND ".join(f"contains(lower(judul || ' ' || content), {q(w)})" for w in P.KEYWORD.split()),
)
def keyword_filter(spark, sf_dir):
    return collect.matching_keyword(articles(spark, sf_dir), P.KEYWORD).select("seq")


@query(
    "a5_publish_date",
    with_ctes(ARTICLES)
    + """SELECT seq, coalesce(CAST(day AS VARCHAR), '') AS day FROM articles
WHERE day IS NULL OR (day >= DATE '2024-01-01' AND day < DATE '2024-02-01')""",
)
def publish_date(spark, sf_dir):
    kept = dated(spark, sf_dir).filter(dates.in_period_or_undated(F.col("day"), START, END))
    return kept.select("seq", F.coalesce(day_text("day"), F.lit("")).alias("day"))


def windowed(spark, sf_dir):
    day = F.col("day")
    items = dated(spark, sf_dir).filter(dates.in_period_or_undated(day, START, END))
    return items.withColumn("win", F.coalesce(dates.week_of_period(day, START), F.lit(0)))


WINDOWED = """items AS (SELECT *, coalesce((day - DATE '2024-01-01') // 7, 0)::INTEGER AS win,
    lower({title}) AS title FROM articles
  WHERE day IS NULL OR (day >= DATE '2024-01-01' AND day < DATE '2024-02-01')),
ranked AS (SELECT *, row_number() OVER (ORDER BY win, seq) AS k FROM items)""".format(
    title=sql_strip("judul")
)
# Greedy scan: conflicting rows are visited in order with the list of kept ones.
GREEDY_KEYS = """edges AS (
  SELECT DISTINCT a.k AS i, b.k AS j FROM ranked a JOIN ranked b ON a.k < b.k AND a.url = b.url
  UNION SELECT DISTINCT a.k, b.k FROM ranked a JOIN ranked b ON a.k < b.k AND a.title = b.title),
nodes AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM (SELECT i AS n FROM edges UNION SELECT j FROM edges)),
neighbours AS (SELECT nodes.n, r, coalesce(list(i) FILTER (i IS NOT NULL), []) AS before
  FROM nodes LEFT JOIN edges ON j = nodes.n GROUP BY nodes.n, r),
scan AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS kept
  UNION ALL
  SELECT b.r, CASE WHEN list_has_any(s.kept, b.before) THEN s.kept ELSE list_append(s.kept, b.n) END
  FROM scan s JOIN neighbours b ON b.r = s.r + 1),
winners AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM scan ORDER BY r DESC LIMIT 1)),
kept AS (SELECT * FROM ranked WHERE k NOT IN (SELECT n FROM nodes) OR k IN (SELECT n FROM winners))"""


@query(
    "a6_feed_dedup",
    with_ctes(ARTICLES, WINDOWED, GREEDY_KEYS, recursive=True) + "SELECT seq, win FROM kept",
)
def feed_dedup(spark, sf_dir):
    return dedup.dedup_feed(windowed(spark, sf_dir)).select("seq", "win")


@query(
    "a7_pool_cap",
    with_ctes(
        ARTICLES,
        WINDOWED,
        f"""counts AS (SELECT win, count(*) AS n FROM items GROUP BY win),
running AS (SELECT win, coalesce(sum(n) OVER (ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts)""",
    )
    + f"SELECT seq, win FROM items WHERE win IN (SELECT win FROM running WHERE before < {3 * P.POOL})",
)
def pool_cap(spark, sf_dir):
    return collect.cap_pool(windowed(spark, sf_dir), 3 * P.POOL).select("seq", "win")


@query(
    "a8_first_rows",
    with_ctes(ARTICLES) + f"SELECT seq, judul FROM articles ORDER BY seq LIMIT {P.POOL}",
)
def first_rows(spark, sf_dir):
    return collect.first_rows(articles(spark, sf_dir), P.POOL).select("seq", "judul")


MAIN_TEXT = "nullif(trim({}), '')".format(
    sql_replace(
        sql_unescape(sql_replace(sql_replace("html", tx.BOILERPLATE, " "), tx.TAG, " ")),
        tx.SPACE + "+",
        " ",
    )
)


@query(
    "a9_page_text",
    f"""WITH extracted AS (SELECT page_id, url, {MAIN_TEXT} AS full_text FROM pages),
accepted AS (SELECT url, arg_min(full_text, page_id) AS full_text FROM extracted
  WHERE full_text IS NOT NULL AND NOT {sql_rejected('full_text')} GROUP BY url)
SELECT page_id AS seq, url, coalesce(full_text, '') AS full_text FROM pages LEFT JOIN accepted USING (url)""",
)
def page_text(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages", "page_id")
    items = pages.select(F.col("page_id").alias("seq"), "url")
    return feed.with_page_text(items, pages, "page_id").select(
        "seq", "url", F.coalesce("full_text", F.lit("")).alias("full_text")
    )


@query("a10_strip_html", f"SELECT page_id, {sql_strip_html('html')} AS stripped FROM pages")
def strip_html(spark, sf_dir):
    return texts(spark, sf_dir, "pages", "page_id").select(
        "page_id", tx.strip_html(F.col("html")).alias("stripped")
    )


@query(
    "a11_quality_gate",
    f"""SELECT doc_id, {sql_words('text')}::INTEGER AS words, {sql_rejected('text')} AS rejected FROM documents""",
)
def quality_gate(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", tx.word_count(text).alias("words"), tx.is_rejected_content(text).alias("rejected")
    )


def fetched(spark, sf_dir):
    """Items whose page text passed the gate, with the second line as description."""
    second = F.split_part("content", F.lit("\n"), F.lit(2))
    return articles(spark, sf_dir).select(
        "seq", "judul",
        F.when(~tx.is_rejected_content(F.col("content")), F.col("content")).alias("full_text"),
        F.concat(F.lit("<p>"), second, F.lit("</p> ")).alias("content"),
    )


FETCHED = f"""fetched AS (SELECT seq, judul, CASE WHEN NOT {sql_rejected('content')} THEN content END AS full_text,
  '<p>' || split_part(content, chr(10), 2) || '</p> ' AS description FROM articles),
summaries AS (SELECT *, nullif({sql_strip_html('description')}, '') AS summary FROM fetched),
filled AS (SELECT seq, judul, coalesce(nullif(full_text, ''), summary, judul, '') AS content,
  nullif(full_text, '') IS NOT NULL AS is_full_text,
  CASE WHEN nullif(full_text, '') IS NOT NULL THEN {q(fixed.STATUS_FULL)}
    WHEN summary IS NOT NULL THEN {q(fixed.STATUS_SUMMARY)} ELSE {q(fixed.STATUS_TITLE)} END AS scrape_status_label
  FROM summaries)"""


def filled(spark, sf_dir):
    return checkpointed(collect.with_fallback_content(fetched(spark, sf_dir)))


@query(
    "a12_fallback_ladder",
    with_ctes(ARTICLES, FETCHED) + "SELECT seq, content, is_full_text, scrape_status_label FROM filled",
)
def fallback_ladder(spark, sf_dir):
    return collect.with_fallback_content(fetched(spark, sf_dir)).select(
        "seq", "content", "is_full_text", "scrape_status_label"
    )


TRIED = f"""tried AS (SELECT * FROM (SELECT *, coalesce(sum(is_full_text::INTEGER) OVER (ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM filled) WHERE before < {P.LIMIT})"""


@query(
    "a13_quota_stop",
    with_ctes(ARTICLES, FETCHED, TRIED) + "SELECT seq, is_full_text FROM tried",
)
def quota_stop(spark, sf_dir):
    return collect.until_quota(filled(spark, sf_dir), P.LIMIT).select("seq", "is_full_text")


@query(
    "a14_top_up",
    with_ctes(ARTICLES, FETCHED)
    + f"""SELECT seq, scrape_status_label, CASE WHEN is_full_text THEN 0 ELSE 1 END::INTEGER AS rank_group FROM filled
WHERE is_full_text OR {sql_strip('content')} <> '' ORDER BY rank_group, seq
LIMIT (SELECT count(*) - 20 FROM documents)""",
)
def top_up(spark, sf_dir):
    # Nearly all rows: the fallback rows after the full texts are reached.
    limit = table(spark, sf_dir, "documents").count() - 20
    return collect.top_up(filled(spark, sf_dir), limit).select(
        "seq", "scrape_status_label", "rank_group"
    )


@query(
    "a14_collection_counts",
    with_ctes(ARTICLES, FETCHED, TRIED)
    + f"""SELECT least((SELECT count(*) FROM tried WHERE is_full_text OR {sql_strip('content')} <> ''), {P.LIMIT})::BIGINT AS jumlah_didapat,
  (SELECT count(*) FROM tried) AS total_pool_dicoba""",
)
def collection_counts(spark, sf_dir):
    tried = collect.until_quota(filled(spark, sf_dir), P.LIMIT)
    return collect.collection_counts(collect.top_up(tried, P.LIMIT), tried)


@query(
    "a15_lexicon_lines",
    with_ctes(
        STEMMED,
        f"""words AS (SELECT unnest(list_distinct(tokens_stemmed)) AS word, seq FROM stemmed),
counted AS (SELECT word, count(*) AS df FROM words GROUP BY word HAVING count(*) >= {P.LEXICON_DOCS})""",
    )
    + "SELECT word, round(((length(word) * 7) % 11 - 5)::DOUBLE, 6) AS weight FROM counted WHERE df % 5 > 1",
)
def lexicon_lines(spark, sf_dir):
    """Lines of a lexicon file, some of them broken, parsed."""
    words = (
        stemmed(spark, sf_dir)
        .select(F.explode(F.array_distinct("tokens_stemmed")).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") >= P.LEXICON_DOCS)
    )
    weight = ((F.length("word") * 7) % 11 - 5).cast("string")
    line = (
        F.when(F.col("df") % 5 == 0, F.col("word"))
        .when(F.col("df") % 5 == 1, F.concat("word", F.lit("\tberat")))
        .otherwise(F.concat(F.lit(" "), F.upper("word"), F.lit("\t"), weight))
    )
    return tables.parse_lexicon_lines(words.select(line.alias("value")))


@query(
    "a16_labelled_set",
    with_ctes(LABELLED)
    + """SELECT seq, text_final, label_manual FROM (SELECT *, row_number() OVER (PARTITION BY text_final ORDER BY seq) AS rn
  FROM labelled WHERE text_final IS NOT NULL AND label_manual IS NOT NULL) WHERE rn = 1""",
)
def labelled_set(spark, sf_dir):
    return tables.labelled_rows(labelled_articles(spark, sf_dir))


@query(
    "a17_report_articles",
    with_ctes(LABELLED) + "SELECT seq, sentiment, text_final FROM labelled",
)
def report_articles(spark, sf_dir):
    return tables.report_articles(labelled_articles(spark, sf_dir)).select(
        "seq", "sentiment", "text_final"
    )
