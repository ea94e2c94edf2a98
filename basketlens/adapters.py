"""The given tables in the shape of the shop's facts and dimensions (see FIXTURES.md)."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.dates import DAY_FORMAT, day_of, day_shift
from basketlens.functions.sentiment import Lexicon
from basketlens.schemas import PARTITION

# Test words, chosen for balance on the given texts and not for meaning.
WORDS = Lexicon(
    positive=frozenset("for with by que und".split()),
    negative=frozenset("was as are des der".split()),
    whole_words=True,
)

# The same for texts read as unsegmented, with words inside other words.
FRAGMENTS = Lexicon(
    positive=frozenset("en ent au ing que".split()),
    negative=frozenset("enta aux ou er un".split()),
    neutral=frozenset("quer over une enti".split()),
)

# The value of "k" in the properties of an event. A pattern, because reading the text as JSON
# costs five times as much, and this is done for each row, in the null filter once more.
CATEGORY_IN_PROPS = r'"k"\\s*:\\s*"?([^,"}\\s]+)'


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def days_between(events: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Events of the run days from ``first`` to ``last``, as a filter the scan can use."""

    def midnight(dt: str) -> Column:
        return F.lit(f"{dt[:4]}-{dt[4:6]}-{dt[6:]}").cast("timestamp_ntz")

    if first is not None:
        events = events.where(F.col("ts") >= midnight(first))
    if last is not None:
        events = events.where(F.col("ts") < midnight(day_shift(last, 1)))
    return events


def day_span(events: DataFrame) -> list[str]:
    """All run days from the first event to the last; two values are fetched."""
    first, last = events.agg(day_of(F.min("ts")), day_of(F.max("ts"))).first()
    days = [first]
    while days[-1] < last:
        days.append(day_shift(days[-1], 1))
    return days


def behavior_facts(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS STRING) END AS user_id",
        "CAST(event_id % 1000 AS STRING) AS goods_id",
        f"nullif(regexp_extract(props, '{CATEGORY_IN_PROPS}', 1), '') AS category_id",
        "CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart'"
        " WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'fav' END AS behavior",
        # Not unix_timestamp, which would bring in the session's time zone.
        "unix_date(CAST(ts AS DATE)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)"
        " AS timestamp",
        "CAST(user_id % 2 AS STRING) AS sex",
        "concat('NATION_', user_id % 25) AS address",
        "concat('dev', user_id % 3) AS device",
        "CAST(value AS DECIMAL(10,2)) AS price",
        "1 AS amount",
        f"date_format(ts, '{DAY_FORMAT}') AS {PARTITION}",
    )


def comment_facts(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "CAST(doc_id % 200 AS STRING) AS user_id",
        "CAST(doc_id % 1000 AS STRING) AS goods_id",
        "CAST(doc_id % 100 AS STRING) AS category_id",
        "text AS comment",
        f"concat('202401', lpad(CAST(doc_id % 30 + 1 AS STRING), 2, '0')) AS {PARTITION}",
    )


def face_dimension(customer: DataFrame) -> DataFrame:
    """Every customer; each eleventh under an id of its own, so that some users are unmatched."""
    return customer.selectExpr(
        "concat(CASE WHEN c_custkey % 11 = 0 THEN 'guest-' ELSE '' END, c_custkey) AS user_id",
        "c_mktsegment AS face",
    )


def category_dimension(part: DataFrame) -> DataFrame:
    """Every part; each tenth under an id of its own, so that some categories are unmatched."""
    return part.selectExpr(
        "concat(CASE WHEN p_partkey % 10 = 9 THEN 'part-' ELSE '' END, p_partkey) AS category_id",
        "p_size AS category_count",
        "p_name AS category_label",
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see, under the session's ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="basketlens-")
    return f"{root.rstrip('/')}/basketlens-{uuid4().hex}"
