import hashlib
import io
import zipfile

import duckdb
import pytest

from loomwork.llm import warc
from loomwork.scratch import Scratch


def run(spark, rows, schema="page_id long, url string, html string, digest string"):
    s = Scratch(spark, "t")
    return warc.round_trip(spark.createDataFrame(rows, schema), s.path("p"), s).toPandas()


def test_defined_results(spark):
    long = "<p>é</p>" * 40
    rows = [(5, "http://a/b c", long, "x"), (2, None, long, None), (9, "u\r\nX: y", long, "x"), (1, "s", "small", None), (3, "s", "small", None), (4, "n", None, None), (6, "n", "", None), (2, None, long, None), (7, "big", "ab" * 2_000_000, None), (None, "q", long, None)]
    out = run(spark, rows)
    assert len(out) == len(rows)
    kinds = {(r.id, r.record_type, r.refers_to) for r in out.astype(object).where(out.notna(), None).itertuples()}
    responses = {(i, "response", None) for i in (None, 1, 2, 3, 4, 6, 7)}
    assert kinds == responses | {(5, "revisit", 2), (9, "revisit", 2)}
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in out.dropna(subset=["id"]).itertuples():
        assert r.digest == hashlib.sha256(html[r.id]).hexdigest() and r.payload_bytes == len(html[r.id])
        assert r.record_type == "revisit" or r.payload == html[r.id]


def test_empty(spark):
    assert len(run(spark, [])) == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    want = duckdb.connect()
    want.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = {tuple(r) for r in want.execute(warc.OP5_SQL).fetchall()}
    got = warc.op5_warc_zip(spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("wide", [False, True])
def test_directory_reads_other_writers(wide):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("é/data.bin", "w", force_zip64=wide) as m:
            m.write(b"0123456789")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = raw.getvalue()
    d = warc.directory(raw, len(data))
    at = warc.data_start(raw, d["é/data.bin"])
    assert warc.read_at(raw, at + 3, 4) == b"3456"
    with pytest.raises(ValueError):
        warc.data_start(raw, d["packed"])
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(data[:40]), 40)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(5):
            z.writestr(f"m{i}", bytes([65 + i]) * 60)
    d = warc.directory(raw, len(raw.getvalue()))
    assert b"PK\x06\x06" in raw.getvalue() and len(d) == 5
    assert all(warc.read_at(raw, warc.data_start(raw, d[f"m{i}"]), d[f"m{i}"].size) == bytes([65 + i]) * 60 for i in range(5))
