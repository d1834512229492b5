"""Direction-of-change rules over stemmed tokens, without joins or shuffles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from wartaframe.functions import fixed_values as fixed
from wartaframe.functions.text import evaluated_once


@dataclass(frozen=True)
class DirectionRules:
    """Words that say up or down, and entity roots that give them a meaning."""

    up: tuple[str, ...] = tuple(fixed.DIRECTION_UP + fixed.STATIC_UP)
    down: tuple[str, ...] = tuple(fixed.DIRECTION_DOWN + fixed.STATIC_DOWN)
    negative_if_up: tuple[str, ...] = tuple(fixed.NEGATIVE_IF_UP)
    positive_if_up: tuple[str, ...] = tuple(fixed.POSITIVE_IF_UP)
    weight: int = field(default=fixed.DIRECTION_WEIGHT)
    window: int = field(default=fixed.DIRECTION_WINDOW)


def direction_matches(tokens: Column, rules: DirectionRules = DirectionRules()) -> Column:
    """array<struct<entity, word, score>>, one per direction word with an entity nearby.

    The neighbourhood is the tokens before and then after the word; its first
    member that contains a root decides, negative roots being tested first.
    """
    return evaluated_once(tokens, lambda t: _matches(t, rules))


def _matches(tokens: Column, rules: DirectionRules) -> Column:
    nothing = r"[^\s\S]"
    negative = "|".join(rules.negative_if_up) or nothing
    either = "|".join(rules.negative_if_up + rules.positive_if_up) or nothing
    size = F.size(tokens)

    def at(position: Column) -> Column:
        word = F.get(tokens, position - 1)
        first = F.greatest(position - rules.window, F.lit(1))
        before = F.slice(tokens, first, position - first)
        after = F.slice(tokens, position + 1, F.lit(rules.window))
        near = F.filter(F.concat(before, after), lambda t: t.rlike(either))
        entity = F.get(near, F.lit(0))
        sign = F.when(entity.rlike(negative), -1).otherwise(1) * F.when(
            word.isin(*rules.up), 1
        ).otherwise(-1)
        return F.struct(
            entity.alias("entity"),
            word.alias("word"),
            (sign * rules.weight).cast("int").alias("score"),
        )

    directed = F.filter(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: F.coalesce(F.get(tokens, i - 1).isin(*rules.up, *rules.down), F.lit(False)),
    )
    return F.filter(F.transform(directed, at), lambda m: m["entity"].isNotNull())


def direction_score(tokens: Column, rules: DirectionRules = DirectionRules()) -> Column:
    return F.aggregate(
        direction_matches(tokens, rules), F.lit(0), lambda total, m: total + m["score"]
    )


def direction_trace(tokens: Column, rules: DirectionRules = DirectionRules()) -> Column:
    """Readable matches such as 'inflasi+tingkat(-3)'."""
    return F.transform(
        direction_matches(tokens, rules),
        lambda m: F.concat(
            m["entity"],
            F.lit("+"),
            m["word"],
            F.lit("("),
            F.when(m["score"] >= 0, F.lit("+")).otherwise(F.lit("")),
            m["score"].cast("string"),
            F.lit(")"),
        ),
    )
