import datetime as dt
import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wartaframe.functions import dates
from wartaframe.functions import direction as dr
from wartaframe.functions import text as tx
from wartaframe.functions.stem import affix_stem, stem_token
from wartaframe.operators import prepare
from wartaframe.sources import tables


def evaluate(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def python_clean(text):
    text = html.unescape(text)
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"http\S+|www\.\S+", " ", text).lower()
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", text).split())


def test_unescape_equals_the_standard(spark):
    """All names with and without semicolon, broken ones, and every number up to beyond the last character."""
    names = [f"&{name}" for name in tx.ENTITIES] + [f"x&{name.rstrip(';')}y; {name}" for name in tx.ENTITIES]
    odd = ["&", "&&", "a&b", "&;", "&#;", "&#x;", "&#X41", "&#65", "&#065;x", "&#00000000000000065;", "&#99999999999999999999;",
           "&#x0000000000110000;", "&#xZ", "&notit;", "&notin;", "&ampamp;", "&amp;lt;", "&amp&lt", "& lt;", "&#12&#x3c;", "&#128;&#x9f",
           "&" + "a" * 40 + ";", "&lt" + "b" * 40, "&CounterClockwiseContourIntegral;", "&AMP&COPY;", "&\u00e9;", "", "no reference"]
    step = 97
    numbers = ["".join(f"&#{n};&#x{n:X}" for n in range(low, low + step)) for low in range(0, 0x110100, step)]
    values = [*names, *odd, *numbers]
    assert evaluate(spark, values, tx.unescape_entities) == [html.unescape(v) for v in values]


def test_clean_text(spark):
    values = ["<b>Harga</b> NAIK 5%&nbsp;&amp; turun", "lihat https://x.id/a?b dan www.y.id", "é tá", "", None,
              "a&lt;b&gt;c", "http x", "&amp;lt;i&amp;gt;"]
    assert evaluate(spark, values, tx.clean_text) == [
        "" if v is None else python_clean(v) for v in values
    ]


def test_cleaning_again_changes_nothing(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(max_size=60), min_size=20, max_size=20))
    def check(values):
        once = evaluate(spark, values, tx.clean_text)
        assert evaluate(spark, once, tx.clean_text) == once

    check()


def test_titles(spark):
    assert evaluate(spark, ["A - B - C", " Satu ", None, "x-y"], tx.title_core) == ["A", "Satu", "", "x-y"]
    rows = [(" Judul - Media ", "Judul - Media"), ("Judul - Media", "Isi"), ("J", None)]
    df = spark.createDataFrame(rows, "t string, c string")
    got = [r[0] for r in df.select(tx.assemble_text(F.col("t"), F.col("c"))).collect()]
    assert got == ["Judul", "Judul Isi", "J"]


def test_strip_covers_unicode_space(spark):
    assert evaluate(spark, ["  a b　\n", None], tx.strip) == ["a b", None]


def test_quality_gate(spark):
    long = "kata " * 40
    assert evaluate(spark, [long, "kata " * 39, long + "Add Preferred Source", "", None], tx.is_rejected_content) == [
        False, True, True, True, True,
    ]


def test_main_text(spark):
    page = (
        "<html><head><title>t</title><style>x</style><script>var a='<p>';</script></head><body><nav>menu</nav>"
        "<!-- c --><div class=\"ad\">iklan</div><p>Isi &amp; inti</p><table><tr><td>1</td></tr></table>"
        "<footer>kaki</footer></body></html>"
    )
    assert evaluate(spark, [page, "<nav>x</nav>"], tx.main_text) == ["Isi & inti", None]


def test_tokens_and_stopwords(spark):
    words = lambda c: tx.drop_stopwords(tx.tokens(c), ["harga"])
    assert evaluate(spark, ["harga naik naik di  pasar", ""], words) == [["naik", "naik", "pasar"], []]
    assert tx.dynamic_stopwords("Harga Beras", "cabai, Gula ,") == ["beras", "cabai", "gula", "harga"]


def test_ngrams(spark):
    def grams(n):
        return lambda c: tx.ngrams(tx.tokens(c), n)

    values = ["a b c", "a", ""]
    assert evaluate(spark, values, grams(2)) == [["a b", "b c"], [], []]
    for n in (1, 2, 3):
        assert [len(g) for g in evaluate(spark, values, grams(n))] == [
            max(0, len(v.split()) - n + 1) for v in values
        ]


def test_slang_and_stems(spark):
    articles = spark.createDataFrame(
        [(1, "pemda naik yg gak kata"), (2, "")], "seq bigint, clean_text string"
    )
    by_rules = prepare.stem_articles(articles).orderBy("seq").collect()
    assert by_rules[0].tokens_stemmed == ["merintah daerah", "naik", "yang", "tidak"]
    assert by_rules[0].text_final == "merintah daerah naik yang tidak"
    assert by_rules[1].tokens_stemmed == []
    stems = spark.createDataFrame([("pemerintah", "perintah"), ("naik", "up"), ("naik", "up2")], "word string, stem string")
    by_table = prepare.stem_articles(articles, stems).orderBy("seq").collect()
    assert by_table[0].tokens_stemmed == ["perintah daerah", "yang", "tidak"]
    assert by_table[1].tokens_stemmed == []
    assert evaluate(spark, ["dibeli", "pembelian", "api"], affix_stem) == ["beli", "beli", "api"]
    assert evaluate(spark, ["makanan minumannya"], stem_token) == ["makan minum"]


@pytest.mark.parametrize(
    "tokens, score, trace",
    [
        (["harga", "naik"], -3, ["harga+naik(-3)"]),
        (["ekspor", "tinggi"], 3, ["ekspor+tinggi(+3)"]),
        (["inflasi", "rendah"], 3, ["inflasi+rendah(+3)"]),
        (["ekspor", "rendah"], -3, ["ekspor+rendah(-3)"]),
        (["naik", "kopi"], 0, []),
        (["harga", "a", "b", "c", "d", "naik"], 0, []),
        (["harga", "b", "c", "d", "naik"], -3, ["harga+naik(-3)"]),
        (["ekspor", "kopi", "harga", "naik"], 3, ["ekspor+naik(+3)"]),
        (["naik", "inflasi"], -3, ["inflasi+naik(-3)"]),
        (["lonjak"], 0, []),
        (["krisis", "lonjak"], 0, ["lonjak+krisis(+3)", "krisis+lonjak(-3)"]),
        ([], 0, []),
    ],
)
def test_direction_rules(spark, tokens, score, trace):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    row = df.select(dr.direction_score(F.col("t")), dr.direction_trace(F.col("t"))).first()
    assert tuple(row) == (score, trace)


def test_dates(spark):
    assert dates.month_period(2025, "Desember") == (dt.date(2025, 12, 1), dt.date(2026, 1, 1))
    assert dates.month_period(2024, "Februari") == (dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    values = ["Mon, 01 Jan 2024 08:00:00 GMT", "01 Jan 2024 08:00:00 GMT", "kemarin", "", None,
              "Mon, 01 Jan 2024 08:00:00 +0700"]
    assert evaluate(spark, values, dates.published_date) == [
        dt.date(2024, 1, 1), dt.date(2024, 1, 1), None, None, None, dt.date(2024, 1, 1),
    ]
    start, end = dates.month_period(2024, "Januari")
    days = [None, dt.date(2024, 1, 31), dt.date(2024, 2, 1)]
    keep = lambda c: dates.in_period_or_undated(c, start, end)
    assert evaluate(spark, days, keep, "date") == [True, True, False]


def test_lexicon_lines(spark):
    lines = ["word\tweight", "Baik Hati\t3", "buruk\t-4.5", "tanpa tab", "", "a\tb\t2", "x\ty"]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    got = {(r.word, r.weight) for r in tables.parse_lexicon_lines(df).collect()}
    assert got == {("baik hati", 3.0), ("buruk", -4.5), ("a\tb", 2.0)}


def test_clean_text_is_told_as_fast_as_it_is_split(spark):
    import time

    texts = spark.range(400).select(F.repeat(F.concat_ws(" ", F.lit("kata ke"), F.col("id").cast("string"), F.lit("")), 2000).alias("x"))
    texts = texts.localCheckpoint()

    def seconds(column):
        best = []
        for _ in range(3):
            began = time.monotonic()
            texts.agg(F.sum(F.size(column))).collect()
            best.append(time.monotonic() - began)
        return min(best)

    # a search for the first other character took ten times as long as the split
    assert seconds(tx.word_tokens(F.col("x"))) < 5 * seconds(tx.tokens(F.col("x")))


def test_words_of_clean_and_other_texts(spark):
    texts = ["kata ke 2", "kata\n", "a-b c", "", None, " x  yz ", "Kata KE", "kata\nke", "été là", "a" * 5000 + "!"]
    want = [[w for w in re.split(r"\W+", (t or "").lower()) if w] for t in texts]
    assert evaluate(spark, texts, lambda x: tx.word_tokens(x, 1)) == want
