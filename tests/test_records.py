"""CSV with line breaks in quoted fields, read in splits (SRC-1): equal to the reader that takes each file in one task."""

from __future__ import annotations

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventscope.sources import EVENT_COLUMNS, clean_events, csv_records, load_errors, load_events
from eventscope.sources.events import LOAD_SCHEMA, csv_options

HEADER = ",".join(EVENT_COLUMNS)


@pytest.fixture
def small_splits(spark):
    """Blocks of a few lines, so that records begin, go on and end in different tasks."""
    settings = {"spark.sql.files.maxPartitionBytes": "600b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _whole(spark, path):
    """Spark's own reader of such files, one task a file."""
    return spark.read.schema(LOAD_SCHEMA).options(**csv_options(), multiLine="true", lineSep="\n").csv(path)


def _rows(df):
    return sorted(map(tuple, df.select(*EVENT_COLUMNS).collect()), key=str)


def _quoted(value: str) -> str:
    return '"' + value.replace('"', '""') + '"'


def _random_file(rng: random.Random, n: int) -> str:
    parts = ["a", "b,", '"', "\n", "\n\n", ",\n", '",', '"\n', " ", "plain text", "\n" * 40]
    out = [HEADER]
    for i in range(n):
        odd = "".join(rng.choices(parts, k=rng.randint(0, 6)))
        other = rng.choice(["", "plain", _quoted(odd), "5\" screen", _quoted("x" * rng.randint(0, 300))])
        fields = ["2020-09-24 11:57:06 UTC", "view", str(i), "7", _quoted(odd) if rng.random() < 0.5 else "code", other, "1.50", str(i % 5), "s"]
        out.append(",".join(fields))
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_one_task_a_file(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(_random_file(rng, 40), encoding="utf-8")
    path = str(tmp_path / "*.csv")
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    raw = load_events(spark, path, multi_line=True)
    want = _rows(_whole(spark, path))
    assert len(want) == 80
    assert _rows(raw) == want
    assert load_errors(raw).first()["corrupt_rows"] == 0


def test_a_record_over_many_blocks_and_two_that_meet_in_a_line(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(300))
    text = f'{HEADER}\nt,view,1,,"{long}",b,1,5,s\nt,view,2,,"x\ny","z\n",1,5,s\nt,view,3,,c,b,1,5,s\n'
    (tmp_path / "x.csv").write_text(text, encoding="utf-8")
    got = {r["product_id"]: r for r in load_events(spark, str(tmp_path / "x.csv"), multi_line=True).collect()}
    assert got["1"]["category_code"] == long
    assert (got["2"]["category_code"], got["2"]["brand"]) == ("x\ny", "z\n")
    assert got["3"]["category_code"] == "c" and len(got) == 3


def test_carriage_returns_header_over_two_lines_and_no_header(spark, tmp_path):
    body = 't,view,1,,"x\r\ny",b,1,5,s\r\nt,view,2,,c,b,1,5,s\r\n'
    (tmp_path / "x.csv").write_bytes(f'"event\r\ntime",{HEADER[11:]}\r\n{body}'.encode())
    want = [("1", "x\r\ny", "s"), ("2", "c", "s")]
    pick = ["product_id", "category_code", "user_session"]
    assert sorted(map(tuple, load_events(spark, str(tmp_path / "x.csv"), multi_line=True).select(*pick).collect())) == want
    (tmp_path / "y.csv").write_bytes(body.encode())
    assert sorted(map(tuple, load_events(spark, str(tmp_path / "y.csv"), header=False, multi_line=True).select(*pick).collect())) == want


def test_a_quote_that_never_ends_is_corrupt_and_nothing_is_gathered(spark, tmp_path, small_splits):
    good = "2020-09-24,view,1,2,c,b,1.00,5,s"
    tail = "".join(f"{good}\n" for _ in range(30))
    (tmp_path / "x.csv").write_text(f'{HEADER}\n{good}\n2020-09-24,view,9,2,"c,b,1.00,5,s\n{tail}', encoding="utf-8")
    (tmp_path / "y.csv").write_text(f"{HEADER}\n{good}\n", encoding="utf-8")
    path = str(tmp_path / "*.csv")
    raw = load_events(spark, path, multi_line=True)
    assert load_errors(raw).first()["corrupt_rows"] == 31
    assert clean_events(raw, on_error="null").where(F.col("product_id") == 1).count() == 2
    with pytest.raises((PySparkException, Py4JJavaError), match="malformed row"):
        clean_events(raw).collect()
    assert csv_records(spark, path).where("NOT complete").count() == 31


def test_empty_files_and_files_of_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("", encoding="utf-8")
    (tmp_path / "b.csv").write_text(HEADER + "\n", encoding="utf-8")
    assert load_events(spark, str(tmp_path / "*.csv"), multi_line=True).count() == 0


def test_lines_without_line_breaks_in_fields_are_not_gathered(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join([HEADER, *[f't,view,{i},,"a, ""b""",b,1,5,s' for i in range(3000)]]), encoding="utf-8")
    raw = load_events(spark, str(tmp_path / "x.csv"), multi_line=True)
    assert raw.where("category_code = 'a, \"b\"'").count() == 3000
    assert load_errors(raw).first()["corrupt_rows"] == 0


def test_filters_above_the_load_see_records_only(spark, tmp_path):
    """Neither the header nor a first line of a record may reach the checks, however the plan is rearranged."""
    good = "2020-09-24,view,1,2,c,b,1.00,5,s"
    (tmp_path / "x.csv").write_text(f'{HEADER}\n{good}\n2020-09-24,view,2,2,"two\nlines",b,1.00,5,s\n', encoding="utf-8")
    events = clean_events(load_events(spark, str(tmp_path / "x.csv"), multi_line=True))
    assert events.where("category_code = 'two\nlines'").count() == 1
    assert events.where("event_time = timestamp '2020-09-24 00:00:00' AND price = 1 AND user_id = 5").count() == 2
