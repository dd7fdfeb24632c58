"""CSV load, cleaning rules and the partitioned write (FIXTURES.md 'Load' cases)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from eventscope.operators import profile_event_share, profile_nulls, profile_volume
from eventscope.sources import load_errors, parse_event_lines, read_table
from eventscope.sources.events import EVENT_SCHEMA, clean_events, load_events, read_events, write_events

from .conftest import as_dicts

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
GOOD = [
    '2020-09-24 11:57:06 UTC,view,1996170,2144415922528452715,electronics.telephone,"",31.90,1515915625519388267,LJuJVLEjPT\n',
    "2020-09-24 11:57:26 UTC,cart,139905,2144415926932472027,,,12.345,1515915625519380411,\n",
    '2020-09-25 00:00:01 UTC,purchase,215454,,"computers ""pro"", notebook",apple,-12.345,,abc\n',
]
BAD = ["2020-09-25 00:00:02 UTC,view,not-a-number,1,x,y,1.00,5,s\n"]


def _csv(tmp_path, lines):
    p = tmp_path / "events.csv"
    p.write_text(HEADER + "".join(lines), encoding="utf-8")
    return str(p)


def test_load_and_clean(spark, tmp_path):
    raw = load_events(spark, _csv(tmp_path, GOOD))
    assert all(f.dataType.typeName() == "string" for f in raw.schema.fields)
    assert load_errors(raw).first().asDict() == {c: 0 for c in load_errors(raw).columns}
    ev = clean_events(raw)
    assert ev.schema == EVENT_SCHEMA
    rows = as_dicts(ev.orderBy("event_time"))
    assert rows[0]["event_time"] == dt.datetime(2020, 9, 24, 11, 57, 6)
    assert rows[0]["brand"] is None  # quoted empty
    assert rows[1]["category_code"] is None and rows[1]["brand"] is None and rows[1]["user_session"] is None
    assert rows[1]["price"] == Decimal("12.35")  # half away from zero
    assert rows[2]["price"] == Decimal("-12.35")
    assert rows[2]["category_code"] == 'computers "pro", notebook'
    assert rows[2]["category_id"] is None and rows[2]["user_id"] is None
    assert rows[0]["user_id"] == 1515915625519388267


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_malformed_value_fails_or_nulls(spark, tmp_path, ansi):
    raw = load_events(spark, _csv(tmp_path, GOOD + BAD))
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises((PySparkException, Py4JJavaError), match="malformed product_id"):
            clean_events(raw).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    rows = as_dicts(clean_events(raw, on_error="null").where("event_type = 'view'").orderBy("event_time"))
    assert rows[-1]["product_id"] is None and rows[-1]["user_id"] == 5


def test_profiles_and_partitioned_write(spark, tmp_path):
    ev = clean_events(load_events(spark, _csv(tmp_path, GOOD)))
    vol = as_dicts(profile_volume(ev))[0]
    assert vol == {
        "total_events": 3, "unique_users": 2, "unique_sessions": 2,
        "first_day": dt.date(2020, 9, 24), "last_day": dt.date(2020, 9, 25), "months_covered": 1,
    }
    nulls = as_dicts(profile_nulls(ev))[0]
    assert nulls == {"null_user_id": 1, "null_user_session": 1, "null_brand": 2, "null_category_code": 1, "null_price": 0}
    share = as_dicts(profile_event_share(ev))
    # shares sum to 100 up to one rounding step per row
    assert abs(sum(r["share_pct"] for r in share) - Decimal("100")) <= Decimal("0.005") * len(share)
    out = str(tmp_path / "table")
    write_events(ev, out)
    back = read_events(spark, out)
    assert back.count() == 3
    plan = back.where("event_date = DATE'2020-09-25'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_empty_input(spark):
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    assert as_dicts(profile_volume(empty))[0]["total_events"] == 0
    assert profile_event_share(empty).count() == 0


def test_streaming_load_is_incremental(spark, tmp_path):
    from eventscope.streaming import start_event_load

    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(HEADER + "".join(GOOD[:2]), encoding="utf-8")
    table, ckpt = str(tmp_path / "table"), str(tmp_path / "ckpt")
    q = start_event_load(spark, str(landing), table, ckpt, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 2
    (landing / "b.csv").write_text(HEADER + GOOD[2], encoding="utf-8")
    q = start_event_load(spark, str(landing), table, ckpt, available_now=True)
    q.awaitTermination(120)
    back = spark.read.parquet(table)
    assert back.count() == 3  # the first file is not loaded twice
    assert sorted(r["event_date"].isoformat() for r in back.select("event_date").distinct().collect()) == [
        "2020-09-24", "2020-09-25"
    ]


def test_bucketed_table_skips_the_session_shuffle(spark, tmp_path, session_events):
    from eventscope.operators import cart_sessions, funnel_sessions
    from eventscope.sources.events import write_events_table

    spark.sql(f"CREATE DATABASE IF NOT EXISTS es_test LOCATION '{tmp_path / 'wh'}'")
    write_events_table(session_events, "es_test.events_bucketed", buckets=4)
    table = spark.table("es_test.events_bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        carts = cart_sessions(table)
        assert carts.count() == 11
        assert "Exchange hashpartitioning" not in carts._jdf.queryExecution().executedPlan().toString()
        fs = funnel_sessions(table, skew_split=False)
        assert sorted(r["user_session"] for r in fs.collect()) == list("ABCDEFIJM")
        plan = fs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # events are never shuffled: the joins read co-located buckets; at most
        # the final assembly of per-session rows moves data
        assert plan.count("SortMergeJoin") >= 2 and plan.count("Exchange hashpartitioning") <= 1
        below_union = plan.split("Union", 1)[1]
        assert "Exchange" not in below_union
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE es_test.events_bucketed")


def test_command_line_load_then_report(spark, tmp_path, capsys):
    from eventscope.__main__ import main

    table, out = str(tmp_path / "table"), str(tmp_path / "reports")
    main(["load", _csv(tmp_path, GOOD), table])
    assert spark.read.parquet(table).count() == 3
    main(["report", table, out])
    printed = capsys.readouterr().out.split()
    assert len(printed) == 15 and all(p.startswith(out) for p in printed)
    assert spark.read.parquet(out + "/volume").first()["total_events"] == 3


def test_streaming_and_command_line_keep_bad_rows_on_request(spark, tmp_path):
    from eventscope.__main__ import main
    from eventscope.streaming import start_event_load

    landing = tmp_path / "landing2"
    landing.mkdir()
    (landing / "a.csv").write_text(HEADER + "".join(GOOD + BAD), encoding="utf-8")
    table, ckpt = str(tmp_path / "stream_table"), str(tmp_path / "stream_ckpt")
    start_event_load(spark, str(landing), table, ckpt, on_error="null", available_now=True).awaitTermination(120)
    back = spark.read.parquet(table)
    assert back.count() == 4 and back.where("product_id IS NULL AND user_id = 5").count() == 1

    cli_table = str(tmp_path / "cli_table")
    main(["load", str(landing / "a.csv"), cli_table, "--on-error", "null"])
    assert spark.read.parquet(cli_table).count() == 4


WIDTH = [
    "2020-09-25 00:00:03 UTC,view,1,2,a,b,1.00,5,s,extra\n",
    "2020-09-25 00:00:04 UTC,view,1,2,a,b,1.00\n",
]
VALUES = {
    "event_time": ["10:11,view,1,2,a,b,1.00,5,s\n", "2020,view,1,2,a,b,1.00,5,s\n"],
    "event_type": ["2020-09-25 00:00:05 UTC," + "v" * 21 + ",1,2,a,b,1.00,5,s\n"],
    "category_code": ["2020-09-25 00:00:05 UTC,view,1,2," + "c" * 201 + ",b,1.00,5,s\n"],
    "brand": ["2020-09-25 00:00:05 UTC,view,1,2,a," + "b" * 101 + ",1.00,5,s\n"],
    "user_session": ["2020-09-25 00:00:05 UTC,view,1,2,a,b,1.00,5," + "s" * 37 + "\n"],
}


@pytest.mark.parametrize("line", WIDTH)
def test_rows_of_another_width_fail_or_are_counted(spark, tmp_path, line):
    raw = load_events(spark, _csv(tmp_path, [*GOOD, line]))
    with pytest.raises((PySparkException, Py4JJavaError), match="malformed row"):
        clean_events(raw).collect()
    assert clean_events(raw, on_error="null").where("event_time IS NULL AND user_id IS NULL AND price IS NULL").count() == 1
    assert load_errors(raw).first()["corrupt_rows"] == 1


@pytest.mark.parametrize("column,line", [(c, line) for c, lines in VALUES.items() for line in lines])
def test_values_out_of_bounds_fail_or_are_counted(spark, tmp_path, column, line):
    raw = load_events(spark, _csv(tmp_path, [*GOOD, line]))
    with pytest.raises((PySparkException, Py4JJavaError), match=f"malformed {column}"):
        clean_events(raw).collect()
    errors = load_errors(raw).first().asDict()
    assert {k for k, v in errors.items() if v} == {f"bad_{column}"}
    assert clean_events(raw, on_error="null").where(F.col(column).isNull() & (F.col("product_id") == 1)).count() == 1


def test_a_date_without_a_time_is_midnight(spark, tmp_path):
    raw = load_events(spark, _csv(tmp_path, ["2020-09-25,view,1,2,a,b,1.00,5,s\n", "2020-09-25T07:08:09+02:00,view,1,2,a,b,1.00,5,s\n"]))
    times = sorted(r["event_time"] for r in clean_events(raw).collect())
    assert times == [dt.datetime(2020, 9, 25), dt.datetime(2020, 9, 25, 5, 8, 9)]


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    path = _csv(tmp_path, [*GOOD, '2020-09-25 00:00:05 UTC,view,1,2,"two\nlines",b,1.00,5,s\n'])
    assert clean_events(load_events(spark, path, multi_line=True)).where(F.col("category_code") == "two\nlines").count() == 1
    assert load_errors(load_events(spark, path)).first()["corrupt_rows"] == 2


def test_lines_parse_as_files_do(spark, tmp_path):
    path = _csv(tmp_path, [*GOOD, *BAD, *WIDTH])
    lines = spark.read.text(path).where(~F.col("value").startswith("event_time,"))
    key = ["event_time", "product_id", "_corrupt_record"]
    assert sorted(map(str, parse_event_lines(lines).select(key).collect())) == sorted(map(str, load_events(spark, path).select(*key).collect()))


def test_appended_files_are_seen(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").count() == 5
    spark.range(7).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").count() == 12


def test_user_bucketed_layout_statistics_and_row_groups(spark, tmp_path, session_events):
    from eventscope.operators import cohort_activity
    from eventscope.sources.events import write_events_table

    spark.sql(f"CREATE DATABASE IF NOT EXISTS es_user LOCATION '{tmp_path / 'wh'}'")
    write_events_table(session_events, "es_user.by_user", buckets=4, bucket_column="user_id")
    try:
        plan = cohort_activity(spark.table("es_user.by_user"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(user_id" not in plan
        stats = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED es_user.by_user user_id").collect()}
        assert int(stats["distinct_count"]) == 13 and int(stats["num_nulls"]) == 0
    finally:
        spark.sql("DROP TABLE es_user.by_user")

    import pyarrow.parquet as pq

    many = session_events.crossJoin(spark.range(400)).drop("id")
    spark.conf.set("parquet.block.size", str(16 * 1024))
    try:
        write_events(many, str(tmp_path / "sorted"), partition_by_date=False)
    finally:
        spark.conf.unset("parquet.block.size")
    scan = spark.read.parquet(str(tmp_path / "sorted")).where("event_type = 'purchase'")
    assert "EqualTo(event_type,purchase)" in scan._jdf.queryExecution().executedPlan().toString()
    skipped = total = 0
    for file in (tmp_path / "sorted").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            bounds = meta.row_group(g).column(1).statistics
            total += 1
            skipped += not bounds.min <= "purchase" <= bounds.max
    assert 0 < skipped < total
