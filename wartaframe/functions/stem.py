"""Affix rules for stemming as a Column expression.

Full stemmers decide with a root dictionary; bring their output as a
(word, stem) table for exact parity. These rules are the fallback for words
the table does not hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Applied in order; each rule leaves at least three letters of the word.
INDONESIAN_AFFIXES: tuple[tuple[str, str], ...] = (
    (r"^(.{3,})(?:lah|kah|pun)$", "$1"),
    (r"^(.{3,})(?:nya|ku|mu)$", "$1"),
    (r"^(.{3,})(?:kan|an)$", "$1"),
    (r"^(?:di|ke|se)(.{4,})$", "$1"),
    (r"^(?:meny|peny)([aiueo].{2,})$", "s$1"),
    (r"^(?:meng|peng)(.{3,})$", "$1"),
    (r"^(?:mem|pem)([bfpv].{2,})$", "$1"),
    (r"^(?:men|pen)([cdjz].{2,})$", "$1"),
    (r"^(?:ber|ter|per)(.{3,})$", "$1"),
    (r"^(?:me|pe)([lmnrwy].{2,})$", "$1"),
)


def affix_stem(word: Column, rules: Sequence[tuple[str, str]] = INDONESIAN_AFFIXES) -> Column:
    for pattern, replacement in rules:
        word = F.regexp_replace(word, pattern, replacement)
    return word


def stem_token(token: Column, rules: Sequence[tuple[str, str]] = INDONESIAN_AFFIXES) -> Column:
    """Stem a token word by word: an expanded abbreviation holds two."""
    words = F.transform(F.split(token, " "), lambda w: affix_stem(w, rules))
    return F.when(F.contains(token, F.lit(" ")), F.array_join(words, " ")).otherwise(
        affix_stem(token, rules)
    )
