"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from wartaframe.session import local_session  # noqa: E402

HEADLINE = (
    "a5_publish_date",
    "a6_feed_dedup",
    "a9_page_text",
    "a14_top_up",
    "c5_clean_text",
    "c15_text_final",
    "c13_stem_table",
    "d1_exact_dedup",
    "d2_tfidf",
    "d3_similar_pairs",
    "d4_near_dedup",
    "s3_phrase_match",
    "s4_direction_score",
    "s7_score_and_matches",
    "m1_corpus_tfidf",
    "m4_stratified_split",
    "m7_prediction_confidence",
    "m12_class_report",
    "e6_golden_upsert",
    "t2_bag_of_words",
    "t5_lda_assignments",
    "t6_coherence",
    "k3_top_bigrams",
    "k5_sentiment_terms",
    "r1_daily_trend",
    "r1_unique_daily_trend",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
