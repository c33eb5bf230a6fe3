import pytest
from pyspark.sql import functions as F

from tickloom.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def pages_by_hand(rows):
    by = {}
    for page_id, html in rows:
        by.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, html in rows:
        body = (html or "").encode()
        best = max(by[html or ""])
        out.append((page_id, len(body), warc.digest32(body), "response" if page_id == best else "revisit", None if page_id == best else best))
    return sorted(out)


def test_round_trip_through_archives(spark):
    long = "é" * 90_000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 50_000
    rows = [(1, "<p>a</p>"), (2, None), (3, ""), (4, "<p>a</p>"), (5, long), (6, long), (7, "0\r\n\r\n"), (9, "<p>a</p>")]
    df = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}", h, "clash") for i, h in rows], SCHEMA)
    path = warc.shared_folder(spark)
    warc.write_archives(df, path, segment_bytes=1000)
    read = warc.read_pages(spark, path)
    by = {r.page_id: r for r in read.collect()}
    assert all(r.complete for r in by.values())
    assert bytes(by[6].payload).decode() == long and bytes(by[7].payload) == b"0\r\n\r\n"
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(read).collect())
    assert got == pages_by_hand(rows)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "", "ab", ""), (2, "", "ab", ""), (3, "", "abcdef", ""), (4, "", "abcdef", "")], SCHEMA)
    path = warc.shared_folder(spark)
    warc.write_archives(df, path, min_revisit_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.read_pages(spark, path).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_missing_segment_is_reported(spark):
    parts = list(warc.records_of("8", "u", b"y" * 5000, None, 1000))
    assert len(parts) > 3
    content = b"".join(p + b"\r\n\r\n" for p in parts[:2] + parts[3:])
    rows = list(warc.parse(content))
    assert [r["segment"] for r in rows] == [1, 2, 4, 5, 6][: len(rows)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], warc.PARSED)
    assert [r.whole for r in warc.reassembled(df).collect()] == [False]


@pytest.mark.parametrize("body", [b"", b"a", b"\r\n" * 9000])
def test_chunked_framing(body):
    assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(warc.chunked(body)[:-5]) is None


def test_empty_table(spark):
    path = warc.shared_folder(spark)
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.resolved(warc.read_pages(spark, path)).count() == 0


def test_query_on_the_pages_table(spark):
    sf = "/root/testdata/sf0.001"
    got = warc.op1_warc_segments(spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert all(r.complete for r in got)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == pages_by_hand([(p.page_id, p.html) for p in pages])


@pytest.mark.parametrize("per_file", [3, 50])
def test_records_over_several_files_are_joined_by_the_shuffle(spark, monkeypatch, per_file):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", per_file)
    rows = [(i, chr(97 + i % 26) * (i * 700)) for i in range(40)] + [(None, "z" * 9000), (7, "y" * 9000)]
    df = spark.createDataFrame([(i, "", h, "") for i, h in rows], SCHEMA)
    path = warc.shared_folder(spark)
    warc.write_archives(df, path)
    files = spark.read.format("binaryFile").load(path).select("content")
    loose = files.mapInPandas(warc._assembled(False), warc.DECODED + warc.SEGMENT_COLUMNS).where("segment is not null")
    assert loose.select(F.coalesce("origin", "record_id")).distinct().count() > 1
    got = warc.read_pages(spark, path).collect()
    assert all(r.complete for r in got)
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in got), key=str) == sorted(rows, key=str)


def test_segments_in_any_order_and_lost_ones():
    records = [r for k in range(3) for r in warc.records_of(str(k), "u", bytes([65 + k]) * 5000, None, 1000, str(k))]
    parsed = [next(warc.parse(r + b"\r\n\r\n")) for r in records]
    joined = warc.Assembler(True)
    for r in reversed(parsed):
        joined.add(r)
    assert {r[0]: r[3] for r in joined.rows} == {k: bytes([65 + k]) * 5000 for k in range(3)} and not joined.open
    joined = warc.Assembler(True)
    for k, r in enumerate(parsed):
        if k != 2:
            joined.add(r)
    assert len(joined.rows) == 2 and len(joined.open) == 1
    assert joined.out()["segment"].notna().sum() == len(parsed) // 3 - 1


def test_long_rows_with_one_page_id_stay_apart(spark):
    a, b = "a" * 50_000, "b" * 60_000
    rows = [(1, a), (1, a), (None, b), (None, a + b), (2, "c" * 3000), (2, "d" * 3000)]
    df = spark.createDataFrame([(i, "", h, "") for i, h in rows], SCHEMA)
    path = warc.shared_folder(spark)
    warc.write_archives(df, path)
    got = warc.read_pages(spark, path).collect()
    assert all(r.complete for r in got)
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in got), key=str) == sorted(rows, key=str)


def test_most_pages_are_reassembled_from_segments(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = warc.shared_folder(spark)
    warc.write_archives(pages, path)
    parts = warc.read_records(spark, path)
    assert parts.where("segment = 1").count() > 0.5 * parts.where("record_type = 'response'").count()


def test_record_ids_are_short_and_distinct():
    body = bytes(range(33, 127)) * 60
    parts = list(warc.records_of("8", "u", body, None, 1000, "77"))
    rows = list(warc.parse(b"".join(p + b"\r\n\r\n" for p in parts)))
    ids = [r["record_id"] for r in rows]
    assert ids[0] == "<urn:row:77:page:8>" and ids[1:] == [f"<urn:row:77:segment:{k}:page:8>" for k in range(2, len(rows) + 1)]
    assert {r["origin"] for r in rows[1:]} == {ids[0]} and [r["segment"] for r in rows] == list(range(1, len(rows) + 1))
    assert sum(map(len, parts)) < 1.5 * len(body) + 1000


def test_segments_of_a_file_in_any_order_and_twice():
    body = b"z" * 9000
    rows = list(warc.parse(b"".join(p + b"\r\n\r\n" for p in warc.records_of("8", "u", body, None, 1000))))
    joined = warc.Assembler(True)
    for r in [rows[-1], *rows[3:-1], rows[4], *rows[:3]]:
        joined.add(r)
    out = joined.out()
    assert len(out) == 2 and out["payload"][1] == body and bool(out["complete"][1]) and out["segment"][0] == 5
