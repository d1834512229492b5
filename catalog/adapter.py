"""The driver's tables in the shape of an article corpus, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import params as P
from wartaframe.functions import text as tx
from wartaframe.operators import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of texts over all cores.

    A table read in fewer splits than there are cores holds less than a split for
    each core, so dealing it out is bounded; any larger table is read as it lies.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id")
    half = docs.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    title = F.concat(first_line, F.lit(" - "), "source")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 45).cast("int"))
    dated = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 08:00:00 GMT"))
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("n_chars") % 29 == 0, "tanpa tanggal").otherwise(dated).alias("tanggal"),
        title.alias("judul"),
        F.when(F.col("text") == first_line, title).otherwise(F.col("text")).alias("content"),
        F.concat(F.lit("u"), (F.col("doc_id") * 7919 % half).cast("string")).alias("url"),
        "source",
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.clean_articles(articles(spark, sf_dir), P.STOPWORDS)


def stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stem_articles(
        cleaned(spark, sf_dir), None, P.AFFIXES, P.SLANG, P.GENERIC
    )


def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned tokens with their stopwords: the direction words are among them."""
    docs = texts(spark, sf_dir, "documents", "doc_id")
    return docs.select(
        F.col("doc_id").alias("seq"), tx.tokens(tx.clean_text(F.col("text"))).alias("tokens")
    )


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (
        F.when(F.col("toxic") == 1, "Negatif").when(F.col("quality") == 1, "Positif").otherwise("Netral")
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), label.alias("label_manual"))


def labelled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a human label as their sentiment and final text; no others are cleaned."""
    chosen = articles(spark, sf_dir).join(human_labels(spark, sf_dir), "seq")
    return prepare.stem_articles(
        prepare.clean_articles(chosen, P.STOPWORDS), None, P.AFFIXES, P.SLANG, P.GENERIC
    ).withColumn("sentiment", F.col("label_manual"))


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def day_text(column: str) -> Column:
    return F.col(column).cast("string")


# --- SQL twins -------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def q_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def q_in(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def sql_replace(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(replacement)}, 'g')"


def sql_strip(text: str) -> str:
    return sql_replace(text, tx.EDGE_SPACE, "")


def _sql_character(code: str) -> str:
    latin = q_list(tx.LATIN_CONTROLS)
    return f"""CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > {tx.LAST_CODE} THEN chr(65533)
  WHEN {code} BETWEEN 128 AND 159 THEN {latin}[{code} - 127]
  WHEN {code} BETWEEN 1 AND 8 OR {code} = 11 OR {code} BETWEEN 14 AND 31 OR {code} = 127
    OR {code} BETWEEN 64976 AND 65007 OR {code} % 65536 >= 65534 THEN ''
  ELSE chr({code}::INTEGER) END"""


def sql_unescape(text: str) -> str:
    """Part by part behind each ampersand; names are looked up in one map."""
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in tx.ENTITIES.items()) + "}"
    digits = "ltrim(regexp_extract(m, '[0-9a-fA-F]+'), '0')"
    number = f"""CASE WHEN length({digits}) > 8 THEN {tx.LAST_CODE + 1} WHEN {digits} = '' THEN 0
  WHEN lower(m[2]) = 'x' THEN TRY_CAST('0x' || {digits} AS BIGINT) ELSE TRY_CAST({digits} AS BIGINT) END"""
    # the longest beginning without a semicolon that is a name, where the whole is none
    named = f"""list_transform([{names}], lambda names: coalesce(names[m],
  list_filter(list_transform(range(length(m) - 1, 1, -1), lambda n: names[m[1:n]] || m[n + 1:]), lambda v: v IS NOT NULL)[1],
  '&' || m))[1]"""
    decoded = f"""list_transform([regexp_extract(p, {q(tx.REFERENCE)}, 1)], lambda m: CASE WHEN m = '' THEN '&' || p
  WHEN m[1] = '#' THEN list_transform([{number}], lambda c: {_sql_character('c')})[1] || p[length(m) + 1:]
  ELSE {named} || p[length(m) + 1:] END)[1]"""
    return f"""CASE WHEN contains({text}, '&') THEN array_to_string(list_transform(string_split({text}, '&'),
  lambda p, i: CASE WHEN i = 1 THEN p ELSE {decoded} END), '') ELSE {text} END"""


def sql_clean(text: str) -> str:
    text = sql_unescape(f"coalesce({text}, '')")
    text = sql_replace(sql_replace(text, tx.TAG, " "), tx.WEB_ADDRESS, " ")
    text = sql_replace(f"lower({text})", r"[^a-z0-9\s]", " ")
    return f"trim({sql_replace(text, r'\s+', ' ')})"


def sql_strip_html(text: str) -> str:
    return f"trim({sql_replace(sql_replace(f'coalesce({text}, {q("")})', tx.TAG, ' '), tx.SPACE + '+', ' ')})"


def sql_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, {q(tx.NON_SPACE + '+')}))"


def sql_rejected(text: str) -> str:
    from wartaframe.functions import fixed_values as fixed

    found = " OR ".join(f"contains(lower({text}), {q(a)})" for a in fixed.UI_ARTIFACTS)
    return f"({sql_words(text)} < {fixed.MIN_ARTICLE_WORDS} OR {found})"


def sql_tokens(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda t: t <> '')"


def sql_keep(tokens: str, stop) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 2 AND t NOT IN {q_in(stop)})"


def sql_stem(word: str) -> str:
    for pattern, replacement in P.AFFIXES:
        word = f"regexp_replace({word}, {q(pattern)}, {q(replacement.replace('$', chr(92)))})"
    return word


def sql_slang(tokens: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.SLANG.items())
    return f"list_transform({tokens}, lambda t: CASE t {cases} ELSE t END)"


ARTICLES = """articles AS (
  SELECT doc_id AS seq,
    CASE WHEN n_chars % 29 = 0 THEN 'tanpa tanggal'
      ELSE strftime(DATE '2024-01-01' + (doc_id % 45)::INTEGER, '%a, %d %b %Y') || ' 08:00:00 GMT' END AS tanggal,
    CASE WHEN n_chars % 29 = 0 THEN NULL
      ELSE DATE '2024-01-01' + (doc_id % 45)::INTEGER END AS day,
    split_part(text, chr(10), 1) || ' - ' || source AS judul,
    CASE WHEN text = split_part(text, chr(10), 1) THEN split_part(text, chr(10), 1) || ' - ' || source
      ELSE text END AS content,
    'u' || (doc_id * 7919 % ((SELECT count(*) FROM documents) // 2)) AS url,
    source
  FROM documents)"""

TITLE_CORE = sql_strip("split_part(judul, ' - ', 1)")
ASSEMBLED = (
    sql_strip(
        f"{TITLE_CORE} || ' ' || CASE WHEN {sql_strip('content')} = {sql_strip('judul')} THEN '' ELSE content END"
    )
)
CLEANED = f"""{ARTICLES},
texts AS (SELECT *, {ASSEMBLED} AS text FROM articles),
cleaned AS (SELECT *, array_to_string({sql_keep(sql_tokens(sql_clean('text')), P.STOPWORDS)}, ' ') AS clean_text FROM texts)"""

_STEM_EACH = (
    "list_transform({tokens}, lambda t: array_to_string("
    "list_transform(string_split(t, ' '), lambda w: {stem}), ' '))"
).format(tokens=sql_slang(sql_tokens("clean_text")), stem=sql_stem("w"))


def stemmed_from(source: str) -> str:
    return f"""stemmed_tokens AS (SELECT *, {sql_keep(_STEM_EACH, P.GENERIC)} AS tokens_stemmed FROM {source}),
stemmed AS (SELECT *, array_to_string(tokens_stemmed, ' ') AS text_final FROM stemmed_tokens)"""


STEMMED = f"{CLEANED},\n{stemmed_from('cleaned')}"

RAW_TOKENS = f"raw_tokens AS (SELECT doc_id AS seq, {sql_tokens(sql_clean('text'))} AS tokens FROM documents)"

HUMAN = """human AS (SELECT doc_id AS seq, CASE WHEN toxic = 1 THEN 'Negatif' WHEN quality = 1 THEN 'Positif'
  ELSE 'Netral' END AS label_manual FROM labels)"""

LABELLED = f"""{STEMMED},
{HUMAN},
labelled AS (SELECT s.*, label_manual, label_manual AS sentiment FROM stemmed s JOIN human USING (seq))"""


def with_ctes(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
