import gzip
import hashlib
import base64
import re

import pytest
from pyspark.sql import functions as F

from lamina.llm import warc


def b32(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://b/\r\nX: 1%", ""), (5, "http://c/5", "x" * 300_000), (None, "u", "<p>é</p>"), (1, "http://a/1", "<p>é</p>"), (9, "", "only")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit(7))


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        d = (h or "").encode()
        if i is not None and len(d) >= least:
            first[d] = min(first.get(d, i), i)
    out = []
    for i, u, h in rows:
        d = (h or "").encode()
        f = first.get(d)
        rev = f is not None and f != i
        out.append((i, len(d), b32(d), "revisit" if rev else "response", f if rev else None, u))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, pages, least):
    rows = [r[:3] for r in pages.collect()]
    got = warc.archive_round_trip(pages, least=least)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, least)


def test_the_query_decodes_no_payload_that_it_does_not_want(spark, pages, tmp_path, monkeypatch):
    """The type is pushed down: the reader of revisits inflates no response, that of responses no revisit."""
    plan = warc.archive_round_trip(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and not re.search(r"\bFilter\b", plan)
    warc.write_warc(pages, f"file://{tmp_path}").collect()
    from pyspark.sql.datasource import EqualTo

    inflated = []
    real = warc.zlib.decompress
    monkeypatch.setattr(warc.zlib, "decompress", lambda data, *a: inflated.append(real(data, *a)) or inflated[-1])
    for kind, rows in (("revisit", 3), ("response", 5)):
        inflated.clear()
        reader = warc.WarcReader({"path": f"file://{tmp_path}", "payload": "false", "sizes": "true"}, [])
        assert list(reader.pushFilters([EqualTo(("record_type",), kind)])) == []
        got = [r for p in reader.partitions() for r in reader.read(p)]
        records = [x for x in inflated if x.startswith(b"WARC/")]
        assert len(got) == rows == len(records) and all(f"WARC-Type: {kind}".encode() in x for x in records)


def test_empty_table(spark, pages):
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_pushdown_and_payloads(spark, pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}").collect()
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}")
    only = df.where("record_type = 'response' and target_uri like 'http://c/%'")
    assert bytes(only.select("payload").first()[0]) == b"x" * 300_000
    heads = spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}").where("record_type = 'revisit'")
    assert {r.payload for r in heads.collect()} == {None}
    reader = warc.WarcReader({"path": f"file://{tmp_path}"}, [])
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("record_type",))])) == []
    assert {r[1] for p in reader.partitions() for r in reader.read(p)} == {"revisit"}


def test_foreign_archives(spark, tmp_path):
    """Members without skip lengths, and plain files, give the same records; unwanted payloads are skipped."""
    recs = [warc.encode_record(i, f"http://x/{i}", (b"p%d" % i) * 5000 * i, b32((b"p%d" % i) * 5000 * i)) for i in range(1, 6)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    (tmp_path / "b.warc").write_bytes(b"".join(recs))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(warc.gzip_member(r) for r in recs))
    warc.register(spark)
    df = spark.read.format("warc").option("verify", "true").load(f"file://{tmp_path}")
    assert sorted(r.payload_bytes for r in df.collect()) == sorted([2 * 5000 * i for i in range(1, 6)] * 3)
    one = df.where("target_uri = 'http://x/3'").collect()
    assert len(one) == 3 and {bytes(r.payload) for r in one} == {b"p3" * 15000}


def test_damage_is_found(spark, tmp_path):
    bad = warc.encode_record(1, "u", b"abc", b32(b"abd"))
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(bad))
    warc.register(spark)
    with pytest.raises(Exception, match="does not match"):
        spark.read.format("warc").option("verify", "true").load(f"file://{tmp_path}").collect()


def test_percent_escapes_of_other_writers_stay(spark, tmp_path):
    """Only a header that this writer marked is unescaped; a URI's own escapes are legal."""
    uri = "http://x/?q=%0A1&r=%25"
    (tmp_path / "a.warc").write_bytes(warc.encode_record(1, uri, b"p", b32(b"p")) + warc.encode_record(2, "a\r\nb%0A", b"q", b32(b"q")))
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}")
    assert {r.page_id: r.target_uri for r in df.collect()} == {1: uri, 2: "a\r\nb%0A"}
    assert df.where(F.col("target_uri") == uri).count() == 1


def test_large_member_of_unknown_length(tmp_path):
    """A member without a skip length is inflated as it is read, and the next one begins where it ends."""
    import io
    import random

    body = random.Random(1).randbytes(5 << 20)
    src = warc._Source(io.BytesIO(gzip.compress(body, 1) + gzip.compress(b"next")))
    assert warc._inflate_member(src) == body and warc._inflate_member(src) == b"next"


def test_query_equals_sql(spark):
    from lamina.llm import queries
    from oracle import compare

    assert compare(spark, queries.QUERIES["op5_warc"], queries.SQL["op5_warc"], "/root/testdata/sf0.001")
