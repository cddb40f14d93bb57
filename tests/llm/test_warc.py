"""WARC archives: round trips, and decisions against plain Python."""

import base64
import gzip
import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest

from evigrid.llm import warc

SCHEMA = "page_id long, url string, html string, row long, key string, type string"


def rows():
    rng = random.Random(2)
    bodies = [None, "", "a", "é x", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x" * 3_000_000, "\x1f\x8b\x08", "<html>" + "ab " * 500]
    bodies += ["".join(rng.choice("abc \r\n") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = [(1000 - i, rng.choice([None, "http://a.b/c", "http://x/\r\ny é"]), b, 1, "k", "t") for i, b in enumerate(bodies * 2)]
    return [*out, out[7], out[3], (None, "u", "a", None, None, None), (None, None, None, None, None, None), (None, None, "only here", None, None, None), *((i, "u", "hot", 0, "", "") for i in range(400))]


def brute(rows, least):
    first = {}
    for key, _, body, *_ in rows:
        b = (body or "").encode()
        first[b] = min(first.get(b, (True, 0)), (key is None, key or 0))
    seen, out = Counter(), Counter()
    for key, _, body, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (body or "").encode()
        new = len(b) < least or not seen[b]
        seen[b] += 1
        refers = None if new or first[b][0] else first[b][1]
        out[key, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if new else "revisit", refers] += 1
    return out


@pytest.mark.parametrize(("least", "arrow"), [(0, True), (3, True), (1 << 40, False)])
def test_round_trip(spark, tmp_path, monkeypatch, least, arrow):
    monkeypatch.setattr(warc, "FILE_RECORDS", 50)
    if not arrow:
        monkeypatch.setattr(warc, "opens", lambda *_: False)
    own = rows()
    warc.write(spark, spark.createDataFrame(own, SCHEMA).repartition(3), str(tmp_path / "w"), "page_id", "html", "url", least)
    found = warc.resolve(spark, warc.read(spark, str(tmp_path / "w")), payloads=True).collect()
    key = lambda text: json.loads(text).get("key") if text else None
    assert Counter((key(r["key"]), r["payload_bytes"], r["payload_digest"], r["type"], key(r["original"])) for r in found) == brute(own, least)
    assert Counter((key(r["key"]), bytes(r["payload"])) for r in found) == Counter((r[0], (r[2] or "").encode()) for r in own)
    assert Counter(r["uri"] for r in found) == Counter(r[1].replace("\r", "%0D").replace("\n", "%0A") if r[1] else None for r in own)
    assert all(r["digest"] == r["payload_digest"] for r in found)
    files = list((tmp_path / "w").glob("part-*"))
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC-Record-ID") == len(own) and len(files) > 3


def test_empty_table(spark, tmp_path):
    warc.write(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "w"), "page_id", "html", "url")
    assert warc.resolve(spark, warc.read(spark, str(tmp_path / "w"))).count() == 0


def record(kind, name, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("buffer", [1, 7, 1 << 20])
def test_archives_of_others(spark, tmp_path, monkeypatch, buffer):
    """Plain and compressed files, other kinds of records, folded headers, revisits that only have a digest or name a record that isn't there."""
    monkeypatch.setattr(warc, "BUFFER", buffer)
    digest = base64.b32encode(hashlib.sha1(b"page").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    own = [
        record("warcinfo", "<i>", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("response", "<a>", http + b"page", Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a/\r\n b"),
        record("revisit", "<b>", http, Content_Type="application/http", WARC_Payload_Digest=f"sha1:{digest}"),
        record("revisit", "<c>", b"", WARC_Refers_To="<a>", WARC_Payload_Digest=f"sha1:{digest}"),
        record("revisit", "<d>", b"", WARC_Refers_To="<nobody>"),
        record("resource", "<e>", b"\r\n\r\nWARC/1.0\r\n\r\n"),
    ]
    assert [(h["warc-record-id"], len(b)) for h, b in warc.records([b"".join(own)])] == [("<i>", 13), ("<a>", 4), ("<b>", 0), ("<c>", 0), ("<d>", 0), ("<e>", 16)]
    (tmp_path / "a.warc").write_bytes(b"".join(own[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in own[3:]))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r["record_id"]: r for r in warc.resolve(spark, warc.read(spark, str(tmp_path)), payloads=True).collect()}
    assert {k: None if r["payload"] is None else bytes(r["payload"]) for k, r in got.items()} == {"<i>": b"software: x\r\n", "<a>": b"page", "<b>": b"page", "<c>": b"page", "<d>": None, "<e>": b"\r\n\r\nWARC/1.0\r\n\r\n"}
    (tmp_path / "c.warc").write_bytes(record("revisit", "<f>", b"", WARC_Refers_To="<a>", WARC_Payload_Digest="sha1:OTHER"))
    with pytest.raises(Exception, match="another payload"):
        warc.resolve(spark, warc.read(spark, str(tmp_path))).collect()
    (tmp_path / "c.warc").write_bytes(own[1][:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, str(tmp_path)).collect()
