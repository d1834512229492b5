"""Annotation samples and the growing set of human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartaframe.functions import fixed_values as fixed
from wartaframe.functions import text as tx


def sampling_key(key: Column, seed: int = fixed.SEED) -> Column:
    """A reproducible pseudo-random order that any engine can recompute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def seeded_sample(rows: DataFrame, n: int, key: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, in the order of their key."""
    return rows.orderBy(sampling_key(F.col(key), seed), key).limit(n).orderBy(key)


def blinded_split(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table to annotate, without predictions, and the table that keeps them."""
    annotation = sample.select(
        "id", "tanggal", "judul", "source", "url",
        tx.truncate(F.col("content")).alias("content"),
        F.lit("").alias("label_manual"),
    )
    return annotation, sample.select("id", "sentiment", "sentiment_score", "text_final")


def normalise_label(raw: Column) -> Column:
    """'Positif', 'Negatif' or 'Netral' whatever the case and blanks; else null."""
    pairs = [F.lit(x) for pair in fixed.LABELS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(tx.strip(raw)))


def unlabelled_count(annotated: DataFrame) -> DataFrame:
    label = normalise_label(F.col("label_manual"))
    return annotated.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(label.isNull()).alias("n_kosong")
    )


def labelled_predictions(annotated: DataFrame, hidden: DataFrame) -> DataFrame:
    """Human labels next to the predictions of the same ids, unlabelled rows left out."""
    collisions = (set(annotated.columns) & set(hidden.columns)) - {"id"}
    hidden = hidden.withColumnsRenamed({c: f"{c}_model" for c in collisions})
    labelled = annotated.withColumn(
        "label_manual_norm", normalise_label(F.col("label_manual"))
    ).filter(F.col("label_manual_norm").isNotNull())
    return labelled.join(hidden, "id")


def upsert_golden(existing: DataFrame | None, labelled: DataFrame) -> DataFrame:
    """All texts once, with their latest label.

    Both sides hold (text_final, label_manual) and an order ``seq``; the labels
    just given come after all existing ones.
    """
    columns = ("text_final", "label_manual", "seq")
    rows = labelled.select(*columns, F.lit(1).alias("batch"))
    if existing is not None:
        rows = existing.select(*columns, F.lit(0).alias("batch")).unionByName(rows)
    latest = F.max(F.struct("batch", "seq", "label_manual")).alias("last")
    return rows.groupBy("text_final").agg(latest, F.min("batch").alias("first_batch")).select(
        "text_final",
        F.col("last.label_manual").alias("label_manual"),
        F.col("last.seq").alias("seq"),
        F.when(F.col("last.batch") == 0, "kept")
        .when(F.col("first_batch") == 1, "inserted")
        .otherwise("updated")
        .alias("change"),
    )


def label_distribution(labelled: DataFrame, label: str = "label_manual") -> DataFrame:
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def remaining_to_train(golden: DataFrame, needed: int = fixed.MIN_GOLDEN_ROWS) -> DataFrame:
    size = F.count(F.lit(1))
    return golden.agg(size.alias("n"), F.greatest(F.lit(0), needed - size).alias("kurang"))


def training_gate(
    labelled: DataFrame, label: str, min_rows: int = fixed.MIN_ROWS_TO_TRAIN
) -> DataFrame:
    """One row: size, distinct labels, smallest class, and whether training is allowed."""
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(
        rows.alias("n"), F.count(F.lit(1)).alias("n_label"), F.min("n").alias("n_min")
    ).withColumn("trainable", (F.col("n") >= min_rows) & (F.col("n_label") >= 2))
