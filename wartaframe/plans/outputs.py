"""Writing and reading the tables that leave or enter a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wartaframe.functions import fixed_values as fixed
from wartaframe.operators import classify, curate, evaluate, report
from wartaframe.schemas import require_columns


def report_tables(result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five report tables of an analysis that found articles."""
    return {
        "ringkasan": report.summary_table(result["run_counts"]),
        "berita": report.report_rows(report.article_results(result["articles"])),
        "kata_kunci": result["top_keywords"],
        "topik_lda": report.topic_table(result["topics"]),
        "validasi_model": report.validation_table(result["validation"]),
    }


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per table below ``path``."""
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if fmt == "csv":
            writer = writer.option("header", True).option("quoteAll", True).option("escape", '"')
        writer.format(fmt).save(f"{path}/{name}")


def write_annotation(articles: DataFrame, n: int, path: str, seed: int = fixed.SEED) -> None:
    """Sample articles and write the blinded and the hidden table."""
    require_columns(articles, ["id", "sentiment", "text_final"])
    annotation, hidden = curate.blinded_split(curate.seeded_sample(articles, n, seed=seed))
    write_report({"anotasi": annotation, "internal": hidden}, path)


def evaluate_annotation(annotated: DataFrame, hidden: DataFrame) -> dict[str, DataFrame]:
    """Metrics of the hidden predictions against the human labels."""
    merged = curate.labelled_predictions(require_columns(annotated, ["label_manual"]), hidden)
    rows = merged.count()
    if rows < fixed.MIN_EVALUATED_ROWS:
        raise ValueError(f"{rows} labelled rows; at least {fixed.MIN_EVALUATED_ROWS} are needed")
    counts = evaluate.confusion_counts(merged, "label_manual_norm", "sentiment")
    labelled = merged.select(
        F.col("id").alias("seq"), "text_final", F.col("label_manual_norm").alias("label_manual")
    )
    return {
        "confusion": counts,
        "metrics": evaluate.overall_metrics(counts),
        "per_class": evaluate.full_report(counts),
        "unlabelled": curate.unlabelled_count(annotated),
        "labelled": labelled,
    }


def write_golden(golden: DataFrame, path: str) -> None:
    """Write the upserted set to a new path; the old one stays readable meanwhile."""
    golden.select("seq", "text_final", "label_manual").write.mode("errorifexists").parquet(path)


def write_model(model: classify.SvmModel, validation: DataFrame, path: str) -> None:
    model.save(f"{path}/model")
    validation.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def read_model(spark: SparkSession, path: str) -> tuple[classify.SvmModel, DataFrame]:
    metrics = spark.read.schema(classify.VALIDATION).json(f"{path}/metrics")
    return classify.SvmModel.load(f"{path}/model"), metrics
