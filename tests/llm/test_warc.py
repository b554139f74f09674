import pytest

from strainshift.llm.warc_store import new_archive, read_archive, sha1_base32, write_archive


def rows_of(spark, data, least=0):
    path = new_archive(spark)
    df = spark.createDataFrame([(*x, "clash") for x in data], "page_id bigint, url string, html string, payload string")
    write_archive(df, path, least=least)
    return path, read_archive(spark, path).collect()


def test_records_come_back(spark):
    data = [(i, f"http://h/{i % 4}", html) for i, html in enumerate(
        ["<p>é", "<p>é", None, "", "x" * 300000, "b", "a", "b", "x" * 300000] + ["hot"] * 50)]
    path, rows = rows_of(spark, data)
    assert len(rows) == len(data)
    by_payload = {}
    for i, _, html in data:
        by_payload.setdefault(html or "", []).append(i)
    for r in rows:
        html = data[r.page][2] or ""
        head = min(by_payload[html])
        assert r.payload == html.encode() and r.payload_digest == sha1_base32(html.encode())
        assert r.record_type == ("response" if r.page == head else "revisit")
        assert r.refers_to == (None if r.page == head else head)
        header = r.header.decode()
        assert header.startswith("WARC/1.1\r\n") and header.endswith("\r\n\r\n") and f"WARC-Target-URI: {data[r.page][1]}\r\n" in header
        assert f"Content-Length: {len(r.payload) if r.page == head else 0}\r\n" in header
    assert spark.read.parquet(f"{path}/payloads").count() == len(by_payload)


def test_small_payloads_are_responses_but_stored_once(spark):
    path, rows = rows_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, None, "abc"), (None, "u", "abc"), (3, None, "abc")], least=3)
    assert sorted((str(r.page), r.record_type) for r in rows) == [
        ("1", "response"), ("2", "response"), ("3", "revisit"), ("3", "revisit"), ("None", "response")]
    assert spark.read.parquet(f"{path}/payloads").count() == 2


def test_empty_and_damaged(spark):
    _, rows = rows_of(spark, [])
    assert rows == []
    path, _ = rows_of(spark, [(1, "u", "abc")])
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("unhex(sha2('other', 256)) AS address", "payload")
    bad.write.mode("append").parquet(f"{path}/payloads2")
    heads = spark.read.parquet(f"{path}/headers").selectExpr("page", "unhex(sha2('other', 256)) AS address", "record_type", "refers_to", "header")
    heads.write.parquet(f"{path}/bad/headers")
    bad.write.parquet(f"{path}/bad/payloads")
    with pytest.raises(Exception, match="damaged"):
        read_archive(spark, f"{path}/bad").collect()
