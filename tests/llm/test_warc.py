from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.op4_warc import op4_warc
from tessera.llm.warc import block_of, derive, folded, header, read_warc, resolved, response_record, write_warc

HTML = '<!DOCTYPE html><html lang="fr"><head><title>A\n title</title><style>p{}</style></head><body><!-- no --><h1>One &amp; two</h1><p>Text <b>bold</b>&nbsp;x<br>next<script>var t="</p>";</script></p><a href="/a?b=1">l</a><A HREF=\'/c\'>m</A></body></html>'


def parse(text):
    """Records of a file by Content-Length, as any reader would."""
    out, data = [], text.encode()
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        out.append((head.decode(), rest[:n].decode()))
        data = rest[n + 4 :]
    return out


@pytest.fixture(scope="module")
def pages(spark):
    tricky = ["", None, HTML, "ends with breaks\r\n\r\n", "holds\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\na start", "é" * 50, "\r\n\r\n\r\n\r\n", HTML]
    return spark.createDataFrame([(i if i < 7 else 2, None if i == 1 else "http://x/\r\nevil: 1" if i == 3 else "http://x/", h) for i, h in enumerate(tricky)], "page_id long, url string, html string")


def test_files_are_warc_and_read_back(spark, pages, tmp_path):
    made = derive(pages.select("page_id", "html", response_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))).cache()
    path = str(tmp_path / "w")
    all_records = made.select(F.explode(F.array("record", "metadata", "conversion")).alias("value"))
    write_warc(all_records.repartition(2), path)
    files = [p.read_bytes().decode() for p in sorted((tmp_path / "w").glob("part-*"))]
    written = [r for f in files for r in parse(f)]
    assert len(written) == 24
    back = read_warc(spark, path)
    assert sorted(r.record for r in back.collect()) == sorted(r.value for r in all_records.collect())
    for compression in ("gzip",):
        write_warc(all_records, path + compression, compression)
        assert sorted(r.record for r in read_warc(spark, path + compression).collect()) == sorted(r.value for r in all_records.collect())
    blocks = back.select(header(F.col("record"), "WARC-Block-Digest").alias("d"), block_of(F.col("record")).alias("b")).collect()
    assert all(r.d == "sha256:" + hashlib.sha256(r.b.encode()).hexdigest() for r in blocks)


def test_links_between_records(pages):
    made = derive(pages.select("page_id", response_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))).collect()
    row = next(r for r in made if r.page_id == 2)
    field = lambda rec, name: m[1] if (m := re.search(rf"\r\n{name}: ([^\r\n]*)", rec.split("\r\n\r\n")[0])) else None
    own = field(row.record, "WARC-Record-ID")
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", own)
    for rec in (row.metadata, row.conversion):
        assert field(rec, "WARC-Refers-To") == own and field(rec, "WARC-Refers-To-Target-URI") == "http://x/" and field(rec, "WARC-Refers-To-Date") == field(row.record, "WARC-Date")
        assert field(rec, "WARC-Source-Payload-Digest") == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert field(row.conversion, "WARC-Concurrent-To") == field(row.metadata, "WARC-Record-ID")
    assert row.conversion.split("\r\n\r\n", 1)[1] == "One & two\nText bold x\nnext\nlm" and row.links == ["/a?b=1", "/c"]
    assert row.metadata.split("\r\n\r\n", 1)[1].split("\r\n") == ["source-status: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(HTML.encode())}", "title: A title", "language: fr", "outlink: /a?b=1", "outlink: /c"]
    assert all("evil" not in line for r in made for line in r.record.split("\r\n") if line.startswith("evil"))


def test_all_headers_and_entities(spark):
    """More header lines than a thousand; entities by name and number, each resolved once; what is none stays."""
    source = "HTTP/1.1 200 OK\r\n" + "\r\n".join(f"X-{i}: {i}" for i in range(1200))
    texts = ["caf&eacute; &#233; &#xE9; &amp;lt; &#x1F600; &nosuch; & &; &#0; &#xD800; &mdash;&nbsp;x", "&lt;b&gt; &amp;amp; &copy;"]
    rows = [(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\n\r\n{source}\r\n\r\n<a href='/x\ny'>1</a><p>{t}</p>",) for i, t in enumerate(texts)]
    made = derive(spark.createDataFrame(rows, "record string")).collect()
    for r in made:
        block = r.metadata.split("\r\n\r\n", 1)[1].split("\r\n")
        assert block[0] == "source-status: HTTP/1.1 200 OK" and block[1:1201] == [f"source-header: X-{i}: {i}" for i in range(1200)] and block[-1] == "outlink: /x y"
    assert [r.text for r in made] == ["1\ncaf\xe9 \xe9 \xe9 &lt; \U0001f600 &nosuch; & &; &#0; &#xD800; \u2014 x", "1\n<b> &amp; \xa9"]


def test_entities_and_lines_in_one_pass_each(spark):
    """A text with common entities is cut once at `&` and once at breaks: no pass for each entity, no pattern over whole texts."""
    texts = [("a&amp;lt;b &#39;q&#39; &quot;&middot;&copy;&nbsp;&gt;", "a&lt;b 'q' \"\u00b7\u00a9 >"), ("x &amp", "x &amp"), ("&", "&"), ("", ""), (" \n a  \t b \n \n\n c&nbsp; \n", "a b\nc"), ("&lt\n;&amp;amp;;", "&lt\n;&amp;;")]
    df = spark.createDataFrame([(t, w) for t, w in texts], "t string, want string").withColumn("plain", resolved(F.col("t"))).withColumn("got", folded(F.col("plain")))
    assert [(r.got, r.plain.count("&")) for r in df.collect()] == [(w, w.count("&")) for _, w in texts]
    plan = df.select("got")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(t#" not in plan and "RLIKE(t#" not in plan and plan.count("regexp_replace(") == 1  # runs of blanks, where there are any


def test_query(spark, sample):
    got = op4_warc(spark, sample).collect()
    ids = {r.record_id for r in got if r.warc_type == "response"}
    assert len(got) == 150 and all(r.intact for r in got) and all(r.refers_to in ids for r in got if r.warc_type != "response")
