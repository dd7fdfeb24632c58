"""Quarantine, replacement at once, repeatable loads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventscope.sources import (
    EVENT_COLUMNS, clean_events, current_version, load_batch, load_errors, load_events, load_with_quarantine, quarantined, read_clean, read_current,
    read_events, read_quarantine, replace_events, vacuum,
)

HEADER = ",".join(EVENT_COLUMNS)
LINES = [
    '2024-01-10 10:00:00 UTC,view,1,2,"a, ""b"".c",x,1.005,7,s1',
    "2024-01-10 10:00:01 UTC,cart,1,,,,,7,s1",
    "10:00,cart,1,2,c,x,abc,7,s1",  # two defects
    "2024-01-10 10:00:02 UTC,cart,1,2,c,x,1.0",  # too few fields
    "2024-01-10 10:00:03 UTC,cart,1,2,c,x,1.0,7,s1,more",  # too many
    "2024-01-10 10:00:04 UTC,cart,1,2,c," + "b" * 101 + ",1.0,7,s1",
    "2024-01-10 10:00:05 UTC,purchase,99999999999999999999,2,c,x,1.0,7,s2",
    "2024-01-11 10:00:05 UTC,purchase,9,2,c,x,1.0,,",
]


@pytest.fixture
def raw(spark, tmp_path):
    file = tmp_path / "events.csv"
    file.write_text("\n".join([HEADER, *LINES]) + "\n")
    return load_events(spark, str(file))


def test_one_pass_keeps_what_it_rejects(spark, raw, tmp_path):
    path = str(tmp_path / "loaded")
    counts = load_with_quarantine(raw, path)
    assert counts == (8, 3, 5, 6) and counts.rows_clean + counts.rows_rejected == counts.rows_read
    clean, bad = read_clean(spark, path), read_quarantine(spark, path)
    good = raw.where(F.col("_corrupt_record").isNull() & F.col("product_id").isin("1", "9") & (F.length("event_time") > 10) & (F.coalesce(F.length("brand"), F.lit(0)) < 101))
    assert clean.dtypes == clean_events(raw).dtypes
    assert sorted(map(str, clean.collect())) == sorted(map(str, clean_events(good).collect())) and clean.count() == 3
    found = sorted(((r.column_name or ""), r.reason, (r.value or "")) for r in bad.collect())
    assert found == [
        ("", "wrong number of fields", ""), ("", "wrong number of fields", ""), ("brand", "too long", "b" * 101), ("event_time", "malformed", "10:00"),
        ("price", "malformed", "abc"), ("product_id", "malformed", "99999999999999999999"),
    ]
    lines = {r.line for r in bad.collect()}
    assert len(lines) == 5 and {LINES[3], LINES[4], LINES[2]} <= lines
    errors = load_errors(raw).first().asDict()
    per_column = {c: sum(r.column_name == c for r in bad.collect()) for c in EVENT_COLUMNS}
    assert {f"bad_{c}": n for c, n in per_column.items()} | {"corrupt_rows": 2} == errors
    assert sorted(map(str, quarantined(raw).collect())) == sorted(map(str, bad.collect()))


def test_nothing_rejected_and_empty_input(spark, raw, tmp_path):
    only = raw.where("user_session = 's1' AND product_id = '1' AND brand IS NULL")
    assert load_with_quarantine(only, str(tmp_path / "a")) == (1, 1, 0, 0)
    assert read_quarantine(spark, str(tmp_path / "a")).collect() == []
    assert load_with_quarantine(raw.limit(0), str(tmp_path / "b")) == (0, 0, 0, 0)
    assert read_clean(spark, str(tmp_path / "b")).collect() == []


def test_a_failed_write_leaves_the_table_as_it_was(spark, session_events, tmp_path):
    path = str(tmp_path / "events")
    with pytest.raises(FileNotFoundError):
        read_current(spark, path)
    first = replace_events(session_events, path)
    before = sorted(map(str, read_current(spark, path).collect()))
    assert before and current_version(spark, path) == first
    # some tasks write their files, one fails
    broken = session_events.withColumn("brand", F.when(F.col("user_id") == 7, F.raise_error(F.lit("half-way")).cast("string")).otherwise(F.col("brand")))
    with pytest.raises(Exception, match="half-way"):
        replace_events(broken, path)
    assert current_version(spark, path) == first and sorted(map(str, read_current(spark, path).collect())) == before

    def refuse(table):
        raise ValueError(f"{table.count()} rows are too few")

    with pytest.raises(ValueError, match="too few"):
        replace_events(session_events.limit(3), path, check=refuse)
    assert current_version(spark, path) == first and vacuum(spark, path) == []


def test_readers_keep_their_version(spark, session_events, tmp_path):
    path = str(tmp_path / "events")
    first = replace_events(session_events, path)
    reader = read_current(spark, path)
    second = replace_events(session_events.where("event_type = 'view'"), path, check=lambda t: t.count() or pytest.fail("empty"))
    assert second != first and reader.count() == session_events.count()
    assert {r.event_type for r in read_current(spark, path).collect()} == {"view"}
    assert vacuum(spark, path) == [first.rsplit("/", 1)[-1]] and read_current(spark, path).count() > 0


def test_loading_a_file_twice_gives_its_rows_once(spark, session_events, tmp_path):
    path = str(tmp_path / "events")
    january, february = session_events.where("event_time < '2024-02-01'"), session_events.where("event_time >= '2024-02-01'")
    load_batch(january, path, "jan.csv")
    load_batch(february, path, "feb.csv")
    load_batch(january, path, "jan.csv")
    table = read_events(spark, path)
    assert sorted(map(str, table.select(*EVENT_COLUMNS).collect())) == sorted(map(str, session_events.collect()))
    # a corrected file: dates that it no longer has go
    load_batch(january.where("event_time < '2024-01-11'"), path, "jan.csv")
    left = read_events(spark, path).select(*EVENT_COLUMNS)
    assert sorted(map(str, left.collect())) == sorted(map(str, session_events.where("event_time < '2024-01-11' OR event_time >= '2024-02-01'").collect()))
    for name in ("", "a/b", "x=y", "_hidden"):
        with pytest.raises(ValueError):
            load_batch(january, path, name)


def test_command_line(spark, raw, tmp_path, capsys):
    from eventscope.__main__ import main

    source, table = str(tmp_path / "events.csv"), str(tmp_path / "table")
    main(["load", source, table, "--quarantine", str(tmp_path / "q"), "--versioned"])
    assert "rows_rejected=5" in capsys.readouterr().out
    assert read_current(spark, table).count() == 3 and read_quarantine(spark, str(tmp_path / "q")).count() == 6
    with pytest.raises(Exception, match="malformed"):
        main(["load", source, table, "--versioned"])
    assert read_current(spark, table).count() == 3
    for _ in range(2):
        main(["load", source, str(tmp_path / "batches"), "--on-error", "null", "--load-id", "events.csv"])
    assert read_events(spark, str(tmp_path / "batches")).count() == len(LINES)
