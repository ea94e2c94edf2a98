from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from basketlens.adapters import shared_folder
from basketlens.schemas import BEHAVIOR_FILE, COMMENT, COMMENT_FILE, GOODS_METRICS, ddl
from basketlens.sinks import (
    HotKeySplit,
    overwrite_day,
    overwrite_days,
    replace_day_jdbc,
    truncate_and_insert,
    write_bucketed,
    write_bucketed_facts,
    write_delimited_text,
)
from basketlens.sinks.jdbc import publish_statements
from basketlens.sources import (
    read_daily_files,
    read_delimited_text,
    read_jdbc_split,
    split_daily_files,
    split_predicates,
    to_behavior,
    to_comment,
)
from tests.compare import rows_of
from tests.test_operators import plan_of

MODE = "spark.sql.sources.partitionOverwriteMode"


def test_daily_files(spark, tmp_path):
    (tmp_path / "20240101.csv").write_text(
        "1,2,3,pv,1704067200,0,Hainan,phone,12,1\n7,8,9,buy,x,1,,,oops,2\n", encoding="utf-8"
    )
    (tmp_path / "20240102.csv").write_text("4,5,6,fav,1704153600,1,a,b,3,1\n", encoding="utf-8")
    one = to_behavior(read_daily_files(spark, str(tmp_path), BEHAVIOR_FILE, ["20240101"]))
    rows = sorted(one.collect())
    assert rows[0][:5] == ("1", "2", "3", "pv", 1704067200)
    assert str(rows[0].price) == "12.00" and rows[0].dt == "20240101"
    assert rows[1].price is None
    every = read_daily_files(spark, str(tmp_path), BEHAVIOR_FILE)
    assert {r.dt for r in every.select("dt").collect()} == {"20240101", "20240102"}
    with pytest.raises(ValueError):
        read_daily_files(spark, str(tmp_path), BEHAVIOR_FILE, name="all.csv")


def test_daily_comments_keep_quotes_commas_and_spaces(spark, tmp_path):
    (tmp_path / "c20240101.txt").write_text(
        '1,2,3,"很好, 真的 ""很好"""\n4,5,6, spaced \n', encoding="utf-8"
    )
    rows = read_daily_files(spark, str(tmp_path), COMMENT_FILE, name="c{dt}.txt")
    found = {r.user_id: (r.comment, r.dt) for r in to_comment(rows).collect()}
    assert found == {"1": ('很好, 真的 "很好"', "20240101"), "4": (" spaced ", "20240101")}


def test_delimited_text_rules(spark, tmp_path):
    (tmp_path / "part").write_text(
        "1,2,3,good, really,yes\n1,,3,\n\\N,2\n,,,\\N\n", encoding="utf-8"
    )
    foreign = read_delimited_text(spark, str(tmp_path), COMMENT, escape=None)
    found = [tuple(r) for r in foreign.collect()]
    assert found == [
        ("1", "2", "3", "good"),
        ("1", "", "3", ""),
        (None, "2", None, None),
        ("", "", "", None),
    ]
    numbers = read_delimited_text(spark, str(tmp_path), (("a", "int"), ("b", "bigint")))
    assert [tuple(r) for r in numbers.collect()] == [(1, 2), (1, None), (None, 2), (None, None)]


def test_text_sink_replaces_and_keeps_one_line_per_row(spark):
    folder = f"{shared_folder(spark)}/text"
    schema = ddl(COMMENT)
    first = spark.createDataFrame([("1", "2", None, "a\r\nb\nc\rd")], schema)
    write_delimited_text(first, folder)
    write_delimited_text(first, folder)
    assert [tuple(r) for r in read_delimited_text(spark, folder, COMMENT).collect()] == [
        ("1", "2", None, "a\r\nb\nc\rd")
    ]


@pytest.mark.parametrize("separator, escape", [(",", "\\"), ("|", "^"), ("\t", "$")])
def test_text_comes_back_whole(spark, separator, escape):
    folder = f"{shared_folder(spark)}/text"
    hard = ["\\N", "\\", "\\\\n", ",\\,", "a,b", "x|^y", "^^s", "$s\t$", "\r\n", "", " ", "'q'\"", None, "a\\nb\\", "N", "日本"]
    columns = tuple((f"c{i}", "string") for i in range(4))
    # Each value in each column.
    rows = [tuple(hard[(i + j) % len(hard)] for j in range(4)) for i in range(len(hard))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in columns))
    write_delimited_text(frame, folder, separator, escape)
    found = [tuple(r) for r in read_delimited_text(spark, folder, columns, separator, escape).collect()]
    assert sorted(found, key=repr) == sorted(rows, key=repr)


def test_text_separator_and_escape_differ(spark):
    with pytest.raises(ValueError):
        write_delimited_text(spark.range(1), "unused", ",", ",")


def test_daily_file_names_are_days(spark, tmp_path):
    (tmp_path / "20240101.csv").write_text("1,2,3,x\n", encoding="utf-8")
    (tmp_path / "backup.csv").write_text("1,2,3,x\n", encoding="utf-8")
    with pytest.raises(Exception, match="not a run day"):
        read_daily_files(spark, str(tmp_path), COMMENT_FILE).collect()


def test_daily_files_count_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "20240101.csv").write_text('1,2,3,"a\nb"\n4,5,6,c\n', encoding="utf-8")
    whole = read_daily_files(spark, str(tmp_path), COMMENT_FILE, multi_line=True)
    assert {r.comment for r in to_comment(whole).collect()} == {"a\nb", "c"}
    (tmp_path / "20240101.csv").write_text("1,2,3,pv,4,0,a,b,12.50,1\n7,8,9,buy,x,1,,,oops,2\n", encoding="utf-8")
    good, bad = split_daily_files(spark, str(tmp_path), BEHAVIOR_FILE)
    assert [str(r.price) for r in good.collect()] == ["12.50"]
    assert [(r.record, r.dt) for r in bad.collect()] == [("7,8,9,buy,x,1,,,oops,2", "20240101")]


def goods_table(spark, database, name="goods"):
    table = f"{database}.{name}"
    spark.sql(f"CREATE TABLE {table} ({ddl(GOODS_METRICS)}, dt string) USING orc PARTITIONED BY (dt)")
    return table


def goods(spark, *rows):
    return spark.createDataFrame(list(rows), ddl(GOODS_METRICS) + ", dt string")


def stored(spark, table):
    return sorted((r.dt, r.category_label, r.total_pv) for r in spark.table(table).collect())


@pytest.mark.parametrize("rebalance", [False, True])
def test_days_are_replaced_and_others_kept(spark, database, rebalance):
    table = goods_table(spark, database)
    mode = spark.conf.get(MODE)
    overwrite_days(goods(spark, ("a", 1, 0, 0, "1"), ("b", 2, 0, 0, "2")), table, rebalance)
    again = goods(spark, ("c", 3, 0, 0, "2"), ("d", 4, 0, 0, "3"))
    for _ in range(2):
        # By name: the order of the frame does not matter.
        overwrite_days(again.select(*reversed(again.columns)), table, rebalance)
    assert stored(spark, table) == [("1", "a", 1), ("2", "c", 3), ("3", "d", 4)]
    assert spark.conf.get(MODE) == mode


def test_a_day_is_replaced_also_by_nothing(spark, database):
    table = goods_table(spark, database)
    overwrite_day(goods(spark, ("a", 1, 0, 0, "x")), table, "20240101")
    overwrite_day(goods(spark, ("b", 2, 0, 0, "x")), table, "20240102")
    assert stored(spark, table) == [("20240101", "a", 1), ("20240102", "b", 2)]
    overwrite_day(goods(spark), table, "20240102")
    assert stored(spark, table) == [("20240101", "a", 1)]
    with pytest.raises(ValueError):
        overwrite_day(goods(spark), table, "2024-01-02")
    with pytest.raises(ValueError, match="not in the target"):
        overwrite_day(goods(spark).withColumn("more", F.lit(1)), table, "20240102")


def test_mode_is_restored_after_a_failed_write(spark, database):
    table = goods_table(spark, database)
    mode = spark.conf.get(MODE)
    broken = goods(spark, ("a", 1, 0, 0, "1")).withColumn(
        "total_pv", F.raise_error(F.lit("lost")).cast("bigint")
    )
    with pytest.raises(Exception, match="lost"):
        overwrite_days(broken, table)
    assert spark.conf.get(MODE) == mode


def test_bucketed_join_has_no_exchange(spark, database):
    facts = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 != 0, (F.col("id") % 300).cast("string"))
        .alias("user_id"),
        F.col("id").alias("n"),
    )
    face = spark.range(400).select(
        F.when(F.col("id") < 2, "hot").otherwise(F.col("id").cast("string")).alias("user_id"),
        (F.col("id") % 7).cast("string").alias("face"),
    )
    from basketlens.operators import join_bucketed

    tables = HotKeySplit(f"{database}.facts", f"{database}.hot")
    write_bucketed_facts(facts, tables, "user_id", 4)
    write_bucketed(face, f"{database}.face", ["user_id"], 4)
    assert {r.user_id for r in spark.table(tables.hot).select("user_id").distinct().collect()} == {"hot", None}
    assert spark.table(tables.bucketed).where("user_id = 'hot' OR user_id IS NULL").count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = spark.table(tables.bucketed).join(spark.table(f"{database}.face"), "user_id", "left")
        assert "SortMergeJoin" in plan_of(plain) and "Exchange" not in plan_of(plain)
        whole = join_bucketed(
            spark.table(tables.bucketed), spark.table(tables.hot), spark.table(f"{database}.face"), "user_id"
        )
        expected = facts.join(face, "user_id", "left").select(*whole.columns)
        assert rows_of(whole.columns, whole.collect()) == rows_of(whole.columns, expected.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- Relational ends, without a database: predicates and statements as SQL, calls recorded --------


@pytest.mark.parametrize(
    ("low", "high", "splits", "spread"),
    [(0, 99, 3, 1), (0, 99, 3, 4), (5, 5, 3, 1), (-7, 11, 4, 2), (0, 1, 8, 3)],
)
def test_split_predicates_place_each_row_once(low, high, splits, spread):
    connection = duckdb.connect()
    connection.execute(
        "CREATE TABLE t AS SELECT CASE WHEN i % 13 <> 0 THEN i END AS user_id,"
        " CASE WHEN i % 7 <> 0 THEN -i END AS goods_id FROM range(-20, 120) r(i)"
    )
    predicates = split_predicates("user_id", low, high, splits, "goods_id", spread)
    assert len(predicates) <= splits * spread
    hits = " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in predicates)
    assert connection.execute(f"SELECT count(*) FROM t WHERE {hits} <> 1").fetchone() == (0,)


def test_split_predicates_check_their_input():
    for bad in [(1, 0, 3), (0, 1, 0)]:
        with pytest.raises(ValueError):
            split_predicates("user_id", *bad)


class RecordingReader:
    def __init__(self, bounds):
        self.calls, self._bounds = [], bounds

    @property
    def read(self):
        return self

    def jdbc(self, url, table, predicates=None, properties=None):
        self.calls.append((url, table, predicates, properties))
        return self

    def first(self):
        return self._bounds


def test_jdbc_scan_asks_bounds_then_reads_ranges():
    session = RecordingReader((0, 29))
    read_jdbc_split(session, "jdbc:x", "behavior_daily", properties={"user": "u"})
    (_, asked, none, _), (url, table, predicates, properties) = session.calls
    assert "MIN(user_id)" in asked and "MAX(user_id)" in asked and none is None
    assert (url, table, properties) == ("jdbc:x", "behavior_daily", {"user": "u"})
    assert predicates == split_predicates("user_id", 0, 29, 3)
    empty = RecordingReader((None, None))
    read_jdbc_split(empty, "jdbc:x", "t")
    assert empty.calls[1][2] == ["1 = 1"]


class RecordingFrame:
    """Takes the place of a frame with a JDBC writer; rows go to a DuckDB table."""

    def __init__(self, connection, rows, columns):
        self.connection, self.rows, self.columns = connection, rows, columns
        self.options, self.calls = {}, []

    @property
    def write(self):
        return self

    def option(self, key, value):
        self.options[key] = value
        return self

    def jdbc(self, url, table, mode, properties):
        self.calls.append((url, table, mode, properties))
        if self.connection is not None:
            self.connection.execute(f"DELETE FROM {table}")
            marks = ", ".join("?" * len(self.columns))
            self.connection.executemany(f"INSERT INTO {table} VALUES ({marks})", self.rows)


class Transaction:
    """A driver connection in the shape of the Python database interface."""

    def __init__(self, connection, fail=False):
        self.connection, self.fail = connection, fail
        connection.execute("BEGIN")

    def cursor(self):
        return self

    def execute(self, statement):
        if self.fail and statement.startswith("INSERT"):
            raise RuntimeError("connection lost")
        self.connection.execute(statement)

    def commit(self):
        self.connection.execute("COMMIT")

    def rollback(self):
        self.connection.execute("ROLLBACK")

    def close(self):
        pass


def test_staging_sink_truncates():
    frame = RecordingFrame(None, [], [])
    truncate_and_insert(frame, "jdbc:x", "behavior_daily", {"user": "u"}, channels=5)
    assert frame.options == {"truncate": "true", "numPartitions": "5"}
    assert frame.calls == [("jdbc:x", "behavior_daily", "overwrite", {"user": "u"})]


def test_export_replaces_its_day_in_one_transaction():
    database = duckdb.connect()
    for table in ("goods_pop", "goods_pop_load"):
        database.execute(f"CREATE TABLE {table} (category_label VARCHAR, score DOUBLE, rk INT, dt VARCHAR)")
    database.execute("INSERT INTO goods_pop VALUES ('old', 1, 1, '20240101'), ('keep', 1, 1, '20231231')")
    # A task that ran twice has loaded its row twice.
    rows = [("new", 2.0, 1, "20240101"), ("new", 2.0, 1, "20240101"), ("more", 1.0, 2, "20240101")]
    frame = RecordingFrame(database, rows, ["category_label", "score", "rk", "dt"])

    def content():
        return sorted(database.execute("SELECT dt, category_label FROM goods_pop").fetchall())

    with pytest.raises(RuntimeError):
        replace_day_jdbc(frame, "jdbc:x", "goods_pop", "20240101", lambda: Transaction(database, fail=True))
    assert content() == [("20231231", "keep"), ("20240101", "old")]
    for _ in range(2):
        replace_day_jdbc(frame, "jdbc:x", "goods_pop", "20240101", lambda: Transaction(database))
        assert content() == [("20231231", "keep"), ("20240101", "more"), ("20240101", "new")]
    with pytest.raises(ValueError):
        publish_statements("goods_pop", "goods_pop_load", ["dt"], "1' OR '1'='1")
