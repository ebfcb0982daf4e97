import hashlib
import random
import time
import zlib

import pytest

from vellum.llm import warc

BIG = "x" * 990 + "é\r\n\r\nWARC/1.0\r\n"


def pages():
    html = [None, "", "short", "short", BIG, BIG, BIG, "y" * 1000, "z" * 999, "z" * 999]
    rows = [(i * 7, f"http://a/{i} ü", h) for i, h in enumerate(html)]
    return rows + [(28, "http://a/again", BIG), (None, None, "y" * 1000), (42, "http://top", BIG), (42, "http://top", BIG)]


def brute(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        best = max((j for j, _, g in rows if (g or "").encode() == body and j is not None), default=None)
        again = len(body) >= 1000 and i != best
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [16_000_000, 1500])
def test_round_trip_matches_brute_force(spark, chars):
    table = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages()], "page_id long, url string, html string, kind string, size int")
    got = warc.convert_pages(table, chars=chars).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(pages())


def test_empty(spark):
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = warc.http_head(4, 5) + b"a\n\nb"
    content = warc.arc_head("n", version, warc.ARC_DATE)
    content += warc.arc_record("n", version, warc.ARC_DATE, "http://a b", len(content), block) + b"\n" + warc.arc_record("n", version, "20240102", "dns:x", 0, b"1.2.3.4")
    for stored in (content, gz(content), gz(content[:40]) + gz(content[40:])):
        found = list(warc.parse_arc(warc.inflated(stored)))
        assert [f["url"] for _, f, _ in found] == ["filedesc://n", "http://a%20b", "dns:x"]
        assert found[1][2] == block and found[2][1]["archive-date"] == "20240102"
        assert [warc.warc_kind(f["url"], b) for _, f, b in found] == ["warcinfo", "response", "resource"]
    with pytest.raises(ValueError):
        list(warc.parse_arc(content[:-5]))


def gz(data):
    z = zlib.compressobj(wbits=31)
    return z.compress(data) + z.flush()


def test_dates_and_warc_errors():
    assert warc.iso_date("20240203040506") == "2024-02-03T04:05:06Z" and warc.iso_date("20240203") == "2024-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"HELLO/1.0\r\nA: b\r\n\r\n"))


def test_members_inflate_in_proportion():
    rng = random.Random(1)
    body = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 70_000]))) for _ in range(30)]
    assert warc.inflated(b"".join(map(gz, body))) == b"".join(body) and warc.inflated(gz(b"a") + b"rest") == b"arest"

    def seconds(n):
        content = gz(bytes(rng.randrange(256) for _ in range(2000))) * n
        start = time.process_time()
        warc.inflated(content)
        return time.process_time() - start

    assert seconds(4000) < 12 * max(seconds(1000), 0.02)


def test_damaged_archives(spark, tmp_path):
    """One archive cut short: an error, or the records before the damage and all other archives."""
    head = warc.arc_head("n", 1, warc.ARC_DATE)
    record = [warc.arc_record("n", 1, warc.ARC_DATE, f"http://a/{k}", 0, warc.http_head(3, k) + b"abc") for k in range(3)]
    (tmp_path / "a.gz").write_bytes(gz(head + record[0] + record[1][:-5]))
    (tmp_path / "b.gz").write_bytes(gz(head) + gz(record[2]))
    found = warc.read_arc(spark, str(tmp_path), strict=False)
    assert sorted(r["page_id"] for r in found.collect()) == [0, 2]
    with pytest.raises(Exception, match="declares"):
        warc.read_arc(spark, str(tmp_path)).collect()


def test_very_long_payload(spark):
    table = spark.createDataFrame([(1, "http://a", "long " * 600_000), (2, "http://b", "x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in warc.convert_pages(table, chars=100_000).collect()}
    assert got == {1: (3_000_000, "response"), 2: (1, "response")}
