"""Text cleaning and projection (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import params as P
from catalog.adapter import (
    ARTICLES, ASSEMBLED, CLEANED, LABELLED, STEMMED, TITLE_CORE, articles, cleaned,
    labelled_articles, q, q_list, sql_clean, sql_replace, sql_slang, sql_stem, sql_tokens,
    sql_unescape, stemmed, texts, with_ctes,
)
from catalog.registry import query
from wartaframe.functions import text as tx
from wartaframe.operators import prepare, report
from wartaframe.session import checkpointed


def pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages", "page_id")


def documents(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id")


#: References in each page of their own kind: named with and without semicolon, decimal, hexadecimal, unknown.
REFERENCES = """ || ' caf&eacute; &rsquo;x&ndash;y &hellip &notit; &unknown; &#' || (page_id * 37) || '; &#x' || lower(to_hex(page_id * 61)) || ' &'"""


def with_references(text):
    return F.concat(
        text, F.lit(" caf&eacute; &rsquo;x&ndash;y &hellip &notit; &unknown; &#"), (F.col("page_id") * 37).cast("string"),
        F.lit("; &#x"), F.lower(F.hex(F.col("page_id") * 61)), F.lit(" &"),
    )


@query("c1_unescape", f"SELECT page_id, {sql_unescape('html')} AS plain FROM (SELECT page_id, html{REFERENCES} AS html FROM pages)")
def unescape(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tx.unescape_entities(with_references(F.col("html"))).alias("plain"))


@query("c2_drop_tags", f"SELECT page_id, {sql_replace('html', tx.TAG, ' ')} AS plain FROM pages")
def drop_tags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", tx.drop_tags(F.col("html")).alias("plain"))


@query(
    "c3_drop_addresses",
    f"SELECT page_id, {sql_replace(q('see ') + ' || url || ' + q(' www.x.id/ ') + ' || html', tx.WEB_ADDRESS, ' ')} AS plain FROM pages",
)
def drop_addresses(spark, sf_dir):
    text = F.concat(F.lit("see "), "url", F.lit(" www.x.id/ "), "html")
    return pages(spark, sf_dir).select("page_id", tx.drop_web_addresses(text).alias("plain"))


@query(
    "c4_letters_and_digits",
    "SELECT doc_id, trim({}) AS plain FROM documents".format(
        sql_replace(sql_replace("lower(text)", r"[^a-z0-9\s]", " "), r"\s+", " ")
    ),
)
def letters_and_digits(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tx.keep_letters_and_digits(F.col("text")).alias("plain")
    )


@query(
    "c5_clean_text",
    f"""SELECT 'd' || doc_id AS id, {sql_clean('text')} AS clean FROM documents
UNION ALL SELECT 'p' || page_id, {sql_clean('html')} FROM pages
UNION ALL SELECT 'r' || page_id, {sql_clean('html')} FROM (SELECT page_id, ''{REFERENCES} AS html FROM pages)""",
)
def clean_text(spark, sf_dir):
    def cleaned(rows, kind: str, key: str, text):
        return rows.select(F.concat(F.lit(kind), key).alias("id"), tx.clean_text(text).alias("clean"))

    docs, landed = documents(spark, sf_dir), pages(spark, sf_dir)
    return (
        cleaned(docs, "d", "doc_id", F.col("text"))
        .union(cleaned(landed, "p", "page_id", F.col("html")))
        .union(cleaned(landed, "r", "page_id", with_references(F.lit(""))))
    )


@query("c6_title_core", with_ctes(ARTICLES) + f"SELECT seq, {TITLE_CORE} AS core FROM articles")
def title_core(spark, sf_dir):
    return articles(spark, sf_dir).select("seq", tx.title_core(F.col("judul")).alias("core"))


@query("c7_assemble_text", with_ctes(ARTICLES) + f"SELECT seq, {ASSEMBLED} AS text FROM articles")
def assemble_text(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "seq", tx.assemble_text(F.col("judul"), F.col("content")).alias("text")
    )


DYNAMIC = tx.dynamic_stopwords(P.KEYWORD, P.EXTRA_STOPWORDS)


@query(
    "c8_dynamic_stopwords",
    f"""WITH cleaned AS (SELECT doc_id, {sql_clean('text')} AS clean FROM documents)
SELECT doc_id, array_to_string(list_filter({sql_tokens('clean')}, lambda t: length(t) > 2 AND t NOT IN ('the', 'of', 'tion', 'ent')), ' ') AS kept
FROM cleaned""",
)
def dynamic_stopwords(spark, sf_dir):
    words = tx.tokens(tx.clean_text(F.col("text")))
    return documents(spark, sf_dir).select(
        "doc_id", tx.join_tokens(tx.drop_stopwords(words, DYNAMIC)).alias("kept")
    )


@query("c9_drop_stopwords", with_ctes(CLEANED) + "SELECT seq, clean_text FROM cleaned")
def drop_stopwords(spark, sf_dir):
    return cleaned(spark, sf_dir).select("seq", "clean_text")


ALL_STOPWORDS = P.STOPWORDS + DYNAMIC


@query(
    "c10_stopword_union",
    f"""WITH tokens AS (SELECT doc_id, unnest({sql_tokens(sql_clean('text'))}) AS word FROM documents)
SELECT doc_id, count(*) AS kept, count(DISTINCT word) AS distinct_kept FROM tokens
WHERE length(word) > 2 AND word NOT IN (SELECT unnest({q_list(ALL_STOPWORDS)})) GROUP BY doc_id""",
)
def stopword_union(spark, sf_dir):
    """Two lists united as tables and taken from the texts by a join."""
    lists = [spark.createDataFrame([(w,) for w in words], "word string") for words in (P.STOPWORDS, DYNAMIC)]
    long_enough = tx.join_tokens(tx.drop_stopwords(tx.tokens(tx.clean_text(F.col("text"))), []))
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), long_enough.alias("clean_text"))
    left = prepare.drop_listed_words(docs, lists[0].union(lists[1]))
    words = tx.tokens(F.col("clean_text"))
    return left.select(F.col("seq").alias("doc_id"), words.alias("w")).select(
        "doc_id",
        F.size("w").cast("bigint").alias("kept"),
        F.size(F.array_distinct("w")).cast("bigint").alias("distinct_kept"),
    ).filter("kept > 0")


@query(
    "c11_tokens",
    with_ctes(CLEANED)
    + f"""SELECT seq, len({sql_tokens('clean_text')})::INTEGER AS n, array_to_string({sql_tokens('clean_text')}, '|') AS tokens FROM cleaned""",
)
def tokens(spark, sf_dir):
    words = tx.tokens(F.col("clean_text"))
    return cleaned(spark, sf_dir).select(
        "seq", F.size(words).alias("n"), F.array_join(words, "|").alias("tokens"),
    )


@query(
    "c12_slang",
    with_ctes(CLEANED)
    + f"SELECT seq, array_to_string({sql_slang(sql_tokens('clean_text'))}, '|') AS normalised FROM cleaned",
)
def slang(spark, sf_dir):
    words = tx.normalise_slang(tx.tokens(F.col("clean_text")), P.SLANG)
    return cleaned(spark, sf_dir).select("seq", F.array_join(words, "|").alias("normalised"))


STEM_TABLE = f"""stem_table AS (SELECT DISTINCT word, upper(left(word, 4)) AS stem FROM
  (SELECT unnest({sql_slang(sql_tokens('clean_text'))}) AS word FROM cleaned) WHERE length(word) % 2 = 0)"""
STEM_RULE = f"array_to_string(list_transform(string_split(word, ' '), lambda w: {sql_stem('w')}), ' ')"


@query(
    "c13_vocabulary_stems",
    with_ctes(CLEANED)
    + f"""SELECT word, {STEM_RULE} AS stem, count(*) AS n
FROM (SELECT unnest({sql_slang(sql_tokens('clean_text'))}) AS word FROM cleaned) GROUP BY word""",
)
def vocabulary_stems(spark, sf_dir):
    words = tx.normalise_slang(tx.tokens(F.col("clean_text")), P.SLANG)
    exploded = cleaned(spark, sf_dir).select(F.explode(words).alias("word"))
    return prepare.vocabulary_stems(exploded, None, P.AFFIXES)


@query(
    "c13_stem_table",
    with_ctes(
        CLEANED,
        STEM_TABLE,
        f"""positions AS (SELECT seq, unnest({sql_slang(sql_tokens('clean_text'))}) AS word,
  generate_subscripts({sql_slang(sql_tokens('clean_text'))}, 1) AS pos FROM cleaned),
parts AS (SELECT seq, pos, unnest(string_split(word, ' ')) AS word, generate_subscripts(string_split(word, ' '), 1) AS place FROM positions),
resolved AS (SELECT seq, pos, string_agg(coalesce(stem, {STEM_RULE}), ' ' ORDER BY place) AS stem
  FROM parts LEFT JOIN stem_table USING (word) GROUP BY seq, pos),
grouped AS (SELECT seq, string_agg(stem, ' ' ORDER BY pos) AS text_final FROM resolved WHERE length(stem) > 2 AND stem NOT IN ('ent', 'eau', 'ers') GROUP BY seq)""",
    )
    + "SELECT seq, coalesce(text_final, '') AS text_final FROM cleaned LEFT JOIN grouped USING (seq)",
)
def stem_table(spark, sf_dir):
    """A stem table for half of the vocabulary, affix rules for the other half."""
    # the words are read for the table, for the vocabulary and for the texts: cleaned once
    docs = checkpointed(cleaned(spark, sf_dir).select("seq", "clean_text"))
    words = tx.normalise_slang(tx.tokens(F.col("clean_text")), P.SLANG)
    stems = (
        docs.select(F.explode(words).alias("word"))
        .filter(F.length("word") % 2 == 0)
        .distinct()
        .select("word", F.upper(F.substring("word", 1, 4)).alias("stem"))
    )
    return prepare.stem_articles(docs, stems, P.AFFIXES, P.SLANG, P.GENERIC).select(
        "seq", "text_final"
    )


@query(
    "c14_post_stem_filter",
    with_ctes(STEMMED) + "SELECT seq, array_to_string(tokens_stemmed, '|') AS tokens FROM stemmed",
)
def post_stem_filter(spark, sf_dir):
    return stemmed(spark, sf_dir).select("seq", F.array_join("tokens_stemmed", "|").alias("tokens"))


@query("c15_text_final", with_ctes(STEMMED) + "SELECT seq, text_final FROM stemmed")
def text_final(spark, sf_dir):
    return stemmed(spark, sf_dir).select("seq", "text_final")


@query(
    "c16_article_results",
    with_ctes(LABELLED)
    + """SELECT tanggal, judul, source, url, content, clean_text, text_final, sentiment,
  CAST(0 AS DOUBLE) AS sentiment_score, '' AS label_topik, false AS is_full_text, '' AS scrape_status_label FROM labelled""",
)
def article_results(spark, sf_dir):
    return report.article_results(labelled_articles(spark, sf_dir))


@query("c17_truncate", "SELECT doc_id, left(text, 1200) AS content FROM documents")
def truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.truncate(F.col("text")).alias("content"))
