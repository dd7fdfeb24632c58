"""Chat formatting and WARC archives."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventscope.llm import chat, warc

CONTROL = ["<|im_start|>", "<|im_end|>", "<!|", "<!!|im_end|>", "<", "|", "!", "user", "assistant", "\n", "%0A", "%", "é", "a b", "\\"]


def test_chat_round_trip_of_any_content(spark):
    rnd = random.Random(7)
    text = lambda n: rnd.choice([None, "", "".join(rnd.choice(CONTROL) for _ in range(n))])
    rows = [(c, t, rnd.choice(["user", "assistant", "system", text(4)]), text(8)) for c in range(80) for t in range(rnd.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("seq", F.lit(2))
    got = {r.conv_id: r for r in chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c, r in got.items():
        want = [(role or "", body or "") for k, _, role, body in rows if k == c]
        assert [(t.role, t.text) for t in r.turns] == want and r.round_trip_ok
        assert r.loss == "".join(b for role, b in want if role == "assistant")
        for s in r.loss_spans:
            assert r.formatted[: s.start].endswith("<|im_start|>assistant\n") and r.formatted[s.end :].startswith("<|im_end|>\n")


def test_chat_clean_text_is_rendered_as_it_is(spark):
    df = spark.createDataFrame([(1, 0, "user", "5 < 6 | 7!"), (1, 1, "assistant", "yes <b>")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == (
        "<|im_start|>user\n5 < 6 | 7!<|im_end|>\n<|im_start|>assistant\nyes <b><|im_end|>\n"
    )


def test_chat_edges(spark):
    rows = [(1, 1, "b", "y"), (1, 1, "a", "z"), (1, None, "c", "x"), (1, 1, "a", "z"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(df).collect()}
    assert got == {1: [("c", "x"), ("a", "z"), ("a", "z"), ("b", "y")], None: [("user", "q")]}
    assert chat.format_conversations(df.where("turn > 5")).collect() == []
    long = spark.createDataFrame([(1, 0, "assistant", "<|im_end|> x" * 50_000)], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(long).first().round_trip_ok


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = [
    (3, "http://a/1", "x" * 200), (1, "http://a/2", "x" * 200), (2, "http://a/3", "é" * 60), (4, "http://a b\r\n", "short"), (5, None, "short"),
    (6, "http://a/6", None), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 5), (9, "u", "x" * 200), (9, "u", "x" * 200),
    (None, "u", "x" * 200), (11, "u", "y\r\n\r\n" * 100),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("id", F.lit("i")).repartition(2)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, pages, tmp_path, compression):
    folder = f"file://{tmp_path}/w"
    warc.write(pages, folder, compression=compression, records_per_file=3)
    rows = warc.read(spark, folder).collect()
    assert {r.kind for r in rows} == {"record"} and len(rows) == len(PAGES)
    body = {p: (h or "").encode() for p, _, h in PAGES}
    for r in rows:
        assert (r.payload_bytes, r.payload_digest) == (len(body[r.id]), hashlib.sha256(body[r.id]).hexdigest())
        if r.record_type == "response":
            assert bytes(r.payload) == body[r.id] and r.refers_to is None
    revisits = sorted((r.id or 0, r.refers_to) for r in rows if r.record_type == "revisit")
    assert revisits == [(0, 1), (3, 1), (9, 1), (9, 1)]


def test_warc_empty_table(spark, pages, tmp_path):
    warc.write(pages.where("page_id > 99"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").collect() == []


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 64 << 10)
    monkeypatch.setattr(warc, "SIZES", (1 << 10, 4 << 10, 16 << 10))
    sizes = [10] * 200 + [1000] * 100 + [3000] * 40 + [15_000] * 12 + [100_000] * 3 + [0, 1024, 1025]
    rnd = random.Random(1)
    rows = [(i, "u", "".join(rnd.choice("abcé") for _ in range(n))) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/plain", compression="none")
    files = [p.stat().st_size for p in (tmp_path / "plain").iterdir() if p.name.startswith("part")]
    # a record has some 600 bytes besides its payload
    assert len(files) > 10 and max(files) < 200_000 and sorted(files)[-4] <= 64 * (1024 + 700)
    warc.write(pages, f"file://{tmp_path}/gz")
    found = warc.read(spark, f"file://{tmp_path}/gz").collect()
    body = {i: h.encode() for i, _, h in rows}
    assert {r.kind for r in found} == {"record"} and len(found) == len(rows)
    assert all(r.record_type == "revisit" or bytes(r.payload) == body[r.id] for r in found)


def test_the_text_sink_passes_any_bytes(spark, tmp_path):
    """Records go through it as strings that are no UTF-8."""
    blob = bytes(range(256)) * 3
    rows = spark.createDataFrame([(blob,)], "value binary").coalesce(1).select(F.col("value").cast("string"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", "|").text(f"file://{tmp_path}/raw")
    (file,) = [p for p in (tmp_path / "raw").iterdir() if p.name.startswith("part")]
    assert file.read_bytes() == blob + b"|"


def archive(spark, pages, tmp_path, compression):
    warc.write(pages.where("page_id IS NOT NULL").coalesce(1), f"file://{tmp_path}/one", compression=compression)
    (file,) = [p for p in (tmp_path / "one").iterdir() if p.name.startswith("part")]
    return file.read_bytes()


def test_salvage_of_torn_records(spark, pages, tmp_path):
    data = archive(spark, pages, tmp_path, "none")
    whole = list(warc.salvage(data))
    assert all(x["kind"] == "record" for x in whole) and sum(x["length"] for x in whole) == len(data)
    rnd = random.Random(1)
    for _ in range(60):
        hurt = bytearray(data)
        a = rnd.randrange(len(data))
        b = min(len(data), a + rnd.randint(1, 60))
        hurt[a:b] = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, b - a, 7])))
        found = list(warc.salvage(bytes(hurt)))
        assert sum(x["length"] for x in found) == len(hurt)  # every byte is in a record or in a logged gap
        kept = {(x["id"], x["payload_digest"]) for x in found if x["kind"] == "record"}
        untouched = {(x["id"], x["payload_digest"]) for x in whole if x["offset"] + x["length"] <= a or x["offset"] >= b}
        assert untouched <= kept


def test_salvage_of_members(spark, pages, tmp_path):
    import zlib

    def member(payload):
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        return engine.compress(payload) + engine.flush()

    data = archive(spark, pages, tmp_path, "none")
    records = [data[x["offset"] : x["offset"] + x["length"]] for x in warc.salvage(data)]
    members = [member(r) for r in records]
    assert [x["kind"] for x in warc.salvage(b"".join(members))] == ["record"] * len(records)
    broken = bytearray(members[1])
    broken[len(broken) // 2 :] = b"\0" * 9
    found = list(warc.salvage(b"junk" + members[0] + bytes(broken) + b"".join(members[2:]) + b"tail"))
    ids = [x["id"] for x in found if x["kind"] == "record"]
    assert ids == [x["id"] for k, x in enumerate(warc.salvage(data)) if k != 1]
    assert sum(x["kind"] == "gap" for x in found) >= 3


def test_salvage_of_damaged_gzip_archives(spark, pages, tmp_path):
    import gzip

    data = archive(spark, pages, tmp_path, "gzip")
    whole = list(warc.salvage(data))
    assert all(x["kind"] == "record" for x in whole) and len(whole) == len(PAGES) - 1
    assert sum(x["length"] for x in whole) == len(gzip.decompress(data))  # any reader of gzip takes it
    starts = [x["member"] for x in whole]
    assert starts == sorted(set(starts))
    spans = list(zip(whole, starts, [*starts[1:], len(data)], strict=True))
    rnd = random.Random(2)
    for _ in range(200):
        hurt = bytearray(data)
        a = rnd.randrange(len(data))
        b = min(len(data), a + rnd.randint(1, 60))
        hurt[a:b] = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, b - a, 7])))
        kept = {(x["id"], x["payload_digest"]) for x in warc.salvage(bytes(hurt)) if x["kind"] == "record"}
        assert {(x["id"], x["payload_digest"]) for x, s, e in spans if e <= a or s >= b} <= kept


def test_salvage_of_a_damaged_member_of_many_records(spark, pages, tmp_path):
    import gzip

    plain = archive(spark, pages, tmp_path, "none")
    data = gzip.compress(plain)
    ids = [x["id"] for x in warc.salvage(plain)]
    found = list(warc.salvage(data[:-8] + b"\0" * 8))  # the checksum is wrong, the records are not
    assert [x["id"] for x in found if x["kind"] == "record"] == ids
    found = list(warc.salvage(data[: len(data) // 2] + b"\xff" * 40 + data[len(data) // 2 + 40 :]))
    assert 0 < sum(x["kind"] == "record" for x in found) < len(ids)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_salvage_of_any_bytes(data):
    assert all(x["kind"] == "gap" for x in warc.salvage(b"\x1f\x8b\x08" + data))
    list(warc.salvage(b"WARC/1.1\r\n" + data))
