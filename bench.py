"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Times are the better of two runs, after a warm-up, of the whole query into a sink that keeps
nothing. ``stages`` are the steps of a run over all given days in a warehouse of tables.
``udf_sentiment`` is a row-at-a-time Python function for the result of ``sentiment_label``, for
comparison only; it is in neither the library nor the total.
"""

from __future__ import annotations

import json
import math
import os
import re
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens import adapters
from basketlens.adapters import WORDS, given
from basketlens.plans import Warehouse, backfill, run_day
from basketlens.registry import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "dwd_user_behavior",
    "dwd_user_comment",
    "dws_face_day",
    "dws_goods_day",
    "dws_goods_reputation_day",
    "agg_salted_face",
    "agg_salted_goods",
    "agg_salted_reputation",
    "dws_face_full",
    "dws_goods_full",
    "dws_goods_reputation_full",
    "history_backfill",
    "ads_goods_pop",
    "ads_face_favorite",
    "ads_goods_pv_to_buy",
    "ads_goods_score",
    "score_weighted",
    "wilson_lower",
    "sentiment_label",
    "sentiment_label_unsegmented",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(work: Callable[[], None], times: int = 2) -> float:
    best = math.inf
    for _ in range(times):
        start = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def stages(spark: SparkSession) -> dict[str, float]:
    wh = Warehouse(spark, adapters.shared_folder(spark), f"bench_{uuid4().hex[:10]}_").create()
    events = given(spark, SF_DIR, "events")
    days = adapters.day_span(events)

    def load() -> None:
        wh.write_text("face", adapters.face_dimension(given(spark, SF_DIR, "customer")))
        wh.write_text("category", adapters.category_dimension(given(spark, SF_DIR, "part")))
        wh.load_dimension("ods_user_face_full", "face")
        wh.load_dimension("ods_category_mapping_full", "category")
        wh.write_days("user_behavior_inc", adapters.behavior_facts(events), rebalance=True)
        documents = given(spark, SF_DIR, "documents")
        wh.write_days("user_comment_inc", adapters.comment_facts(documents), rebalance=True)

    return {
        "load_all_days": seconds(load, 1),
        "backfill_all_days": seconds(lambda: backfill(wh, days, WORDS), 1),
        "run_last_day": seconds(lambda: run_day(wh, days[-1], WORDS)),
        "run_last_day_salted": seconds(lambda: run_day(wh, days[-1], WORDS, salts=10)),
    }


def udf_sentiment(spark: SparkSession) -> DataFrame:
    positive, negative = WORDS.positive, WORDS.negative

    @F.udf("int")
    def label(text: str) -> int:
        words = re.findall(r"[^\W\d_]+", text.lower())
        return int(sum((w in positive) - (w in negative) for w in words) >= 1)

    return given(spark, SF_DIR, "documents").select("doc_id", label("text").alias("label"))


def main() -> None:
    spark = session()
    run(QUERIES["ads_goods_pop"](spark, SF_DIR))
    queries = {n: seconds(lambda n=n: run(QUERIES[n](spark, SF_DIR))) for n in HEADLINE}
    compared = {
        "udf_sentiment": seconds(lambda: run(udf_sentiment(spark))),
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "stages": stages(spark),
                "compared": compared,
                "rows": {
                    "events": given(spark, SF_DIR, "events").count(),
                    "documents": given(spark, SF_DIR, "documents").count(),
                },
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
