"""Text cleaning as Column expressions (no Python in the data path)."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from wartaframe.functions import fixed_values as fixed

# Unicode white space spelled out, so that a pattern means the same in every
# regex dialect instead of depending on its idea of \s.
_SPACE_SET = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{_SPACE_SET}]"
NON_SPACE = f"[^{_SPACE_SET}]"
EDGE_SPACE = f"^{SPACE}+|{SPACE}+$"
SPACE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
TAG = "<[^>]+>"
WEB_ADDRESS = rf"http{NON_SPACE}+|www\.{NON_SPACE}+"
NOT_ALPHANUMERIC = "[^a-z0-9]+"

# What may follow an ampersand: a decimal or hexadecimal number, or a name.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0c <&#;]{1,32};?)"
#: Standard names with what they stand for; some also count without their semicolon.
ENTITIES: Mapping[str, str] = dict(html5)
_LONGEST_OPEN_NAME = max(len(name) for name in ENTITIES if not name.endswith(";"))
REPLACEMENT = "�"
#: Numbers from 0x80 to 0x9f mean the characters of code page 1252 where it has one.
LATIN_CONTROLS = tuple(
    bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0)
)
LAST_CODE = 0x10FFFF

_BLOCKS = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "table")
BOILERPLATE = "(?is)" + "|".join(
    ["<!--.*?-->"]
    + [rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in _BLOCKS]
    + [r'<div class="(?:ad|ads|comments?)"[^>]*>.*?</div\s*>', r"<title\b[^>]*>.*?</title\s*>"]
)


def evaluated_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where the body may read the value many times, also per element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def _entity_names() -> Column:
    """The names as one constant: a map of maps by first character, so a lookup reads few keys."""
    groups: dict[str, dict[str, str]] = defaultdict(dict)
    for name, characters in ENTITIES.items():
        groups[name[0]][name] = characters
    return F.from_json(F.lit(json.dumps(groups)), "map<string,map<string,string>>")


def _named(reference: Column, names: Column) -> Column:
    """What a name stands for; else its longest beginning that counts without a semicolon."""

    def known(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name)

    beginnings = [
        F.when(
            F.length(reference) > n,
            F.concat(known(F.left(reference, F.lit(n))), F.substr(reference, F.lit(n + 1))),
        )
        for n in range(_LONGEST_OPEN_NAME, 1, -1)
    ]
    return F.coalesce(known(reference), *beginnings, F.concat(F.lit("&"), reference))


def _character(code: Column) -> Column:
    """The character of a number; none for numbers that no text may hold."""
    plane_end = F.pmod(code, F.lit(0x10000)) >= 0xFFFE
    control = code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
    latin = F.array(*[F.lit(c) for c in LATIN_CONTROLS])
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > LAST_CODE), REPLACEMENT)
        .when(code.between(0x80, 0x9F), F.get(latin, (code - 0x80).cast("int")))
        .when(code == 0xFEFF, "\ufeff")  # a decoder takes it for a byte-order mark
        .when(control | code.between(0xFDD0, 0xFDEF) | plane_end, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _numbered(reference: Column) -> Column:
    def digits(pattern: str, base: int) -> Column:
        # leading zeros say nothing; what is longer than any character's number is above all of them
        text = F.ltrim(F.regexp_extract(reference, pattern, 0), F.lit("0"))
        code = F.coalesce(F.conv(text, base, 10).cast("long"), F.lit(0))
        return F.when(F.length(text) > 8, F.lit(LAST_CODE + 1)).otherwise(code)

    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    code = F.when(hexadecimal, digits("[0-9a-fA-F]+", 16)).otherwise(digits("[0-9]+", 10))
    return evaluated_once(code, _character)


def unescape_entities(text: Column) -> Column:
    """Character references decoded in one pass: what it produces is not decoded again."""
    names = _entity_names()

    def decoded(part: Column) -> Column:
        def whole(reference: Column) -> Column:
            rest = F.substr(part, F.length(reference) + 1)
            value = F.when(F.startswith(reference, F.lit("#")), _numbered(reference)).otherwise(_named(reference, names))
            return F.when(reference == "", F.concat(F.lit("&"), part)).otherwise(F.concat(value, rest))

        return evaluated_once(F.regexp_extract(part, REFERENCE, 1), whole)

    parts = F.transform(F.split(text, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(decoded(part)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def drop_web_addresses(text: Column) -> Column:
    return F.regexp_replace(text, WEB_ADDRESS, " ")


def keep_letters_and_digits(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), NOT_ALPHANUMERIC, " "))


def clean_text(text: Column) -> Column:
    """Entities, tags, addresses, case and punctuation; null becomes ''.

    Most texts have no markup or address: a plain search of the raw text spares
    them the passes that could not change anything.
    """
    text = F.coalesce(text, F.lit(""))
    marked_up = F.contains(text, F.lit("&")) | F.contains(text, F.lit("<"))
    addressed = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www."))
    plain = F.when(marked_up, drop_tags(unescape_entities(text))).otherwise(text)
    plain = F.when(addressed, drop_web_addresses(plain)).otherwise(plain)
    return keep_letters_and_digits(plain)


def strip_html(text: Column) -> Column:
    text = drop_tags(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def main_text(html: Column) -> Column:
    """Readable text of a landed page without boilerplate; null when none is left."""
    body = unescape_entities(drop_tags(F.regexp_replace(html, BOILERPLATE, " ")))
    return F.nullif(F.trim(F.regexp_replace(body, f"{SPACE}+", " ")), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{NON_SPACE}+"))


def is_rejected_content(
    text: Column,
    min_words: int = fixed.MIN_ARTICLE_WORDS,
    artifacts: Iterable[str] = tuple(fixed.UI_ARTIFACTS),
) -> Column:
    """Too short, or text of the aggregator's own interface."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    rejected = word_count(text) < min_words
    for artifact in artifacts:
        rejected = rejected | F.contains(lowered, F.lit(artifact))
    return rejected


def title_core(title: Column) -> Column:
    """The part before the first ' - ' (what follows names the publisher)."""
    return strip(F.substring_index(F.coalesce(title, F.lit("")), " - ", 1))


def title_key(title: Column) -> Column:
    return F.lower(strip(title))


def assemble_text(title: Column, content: Column) -> Column:
    """Core title and content; content that only repeats the title is left out."""
    title = F.coalesce(title, F.lit(""))
    content = F.coalesce(content, F.lit(""))
    body = F.when(strip(content) == strip(title), F.lit("")).otherwise(content)
    return strip(F.concat(title_core(title), F.lit(" "), body))


def tokens(text: Column) -> Column:
    """Blank-separated tokens; the empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def word_tokens(text: Column, min_length: int = 2) -> Column:
    """Lower-case runs of word characters with at least ``min_length`` of them."""

    def words(t: Column) -> Column:
        # Cleaned text is by far the most common input and needs no word pattern. To match it as a
        # whole takes a fifteenth of the time of a search for what it does not hold.
        return F.when(F.rlike(t, F.lit(r"\A[a-z0-9 ]*+\z")), F.split(t, " ")).otherwise(
            F.split(t, r"(?U)\W+")
        )

    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(evaluated_once(lowered, words), lambda w: F.length(w) >= min_length)


def dynamic_stopwords(keyword: str = "", extra: str = "") -> list[str]:
    """Words of the search keyword and of a comma-separated list, lower-cased."""
    words = keyword.lower().split()
    words += [w.strip().lower() for w in extra.split(",")] if extra else []
    return sorted({w for w in words if w})


def _string_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def drop_stopwords(words: Column, stopwords: Iterable[str], min_length: int = 3) -> Column:
    """Keep longer tokens outside the list, with their order and repetitions."""
    stop = sorted(set(stopwords))
    if not stop:
        return F.filter(words, lambda t: F.length(t) >= min_length)
    return F.filter(words, lambda t: (F.length(t) >= min_length) & ~t.isin(stop))


def normalise_slang(words: Column, slang: Mapping[str, str] = fixed.SLANG) -> Column:
    """Exact token replacement; a replacement may hold two words in one token."""
    if not slang:
        return words
    pairs = [F.lit(x) for pair in slang.items() for x in pair]
    table = F.create_map(*pairs)
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def post_stem_filter(
    words: Column, generic: Iterable[str] = tuple(fixed.POST_STEM_STOPWORDS)
) -> Column:
    return drop_stopwords(words, generic)


def join_tokens(words: Column) -> Column:
    return F.array_join(words, " ")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, in order."""

    def runs(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.array_join(F.slice(w, i, n), " "),
        )
        return F.when(last >= 1, grams).otherwise(_string_array([]))

    return words if n == 1 else evaluated_once(words, runs)


def truncate(text: Column, length: int = fixed.ANNOTATION_CHARS) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def contains_all_terms(keyword: str, *columns: Column) -> Column:
    """Every word of the keyword occurs in the joined lower-case columns."""
    haystack = F.lower(F.concat_ws(" ", *columns))
    condition = F.lit(True)
    for term in keyword.lower().split():
        condition = condition & F.contains(haystack, F.lit(term))
    return condition
