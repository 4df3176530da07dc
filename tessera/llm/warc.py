r"""Operator 4: WARC derivatives. Responses become linked metadata and plain-text conversion records.

Records are text, so a WARC file is what Spark's text writer makes of them with CR LF CR LF as the line end, which is how
the format ends a record. Files are read by the line a record begins with; a block that itself holds an end and
such a line is written in base64 and says so in `Content-Transfer-Encoding`. Content-Length tells whether the last
record of a file still has its end. Digests are of blocks as they were given.

From each response (`response_record` makes them of pages where there is no crawl to read):
- metadata (application/warc-fields): outlinks, title, language and the source's own HTTP headers;
- conversion (text/plain): the text of its HTML.
Both name the response in WARC-Refers-To and repeat its target URI and date (WARC-Refers-To-Target-URI,
WARC-Refers-To-Date); the conversion is WARC-Concurrent-To its metadata; WARC-Block-Digest is of the block,
WARC-Source-Payload-Digest carries the response's payload digest. Digests are sha256, hexadecimal. Record ids are
UUIDs (version 8 form) from a digest of what identifies the record, so a lost task writes the same ids again.

Defined results: null or empty HTML gives an empty payload and an empty conversion; a null or empty URL no target
URI; CR LF within header values becomes a space; rows with one page_id and equal content have equal record ids.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
FIRST = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def record_id(*parts: Column) -> Column:
    """urn:uuid of a digest: 8-4-4-4-12 hexadecimal digits, version 8, variant 8."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines, in order; those with a null value are left out."""
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{k}: "), v) for k, v in pairs])


def record(headers: Column, block: Column) -> Column:
    """A record without its closing CR LF CR LF; adds Content-Length in bytes."""
    risky = F.contains(block, F.lit(END + FIRST))
    written = F.when(risky, F.base64(F.encode(block, "UTF-8"))).otherwise(block)
    coding = F.when(risky, F.lit(f"{CRLF}Content-Transfer-Encoding: base64")).otherwise("")
    return F.concat(F.lit(FIRST), headers, coding, F.lit(f"{CRLF}Content-Length: "), F.octet_length(written).cast("string"), F.lit(END), written)


def header(record_or_head: Column, name: str) -> Column:
    """A field's value in the named-field block at the start; null if it is empty or not there."""
    head = F.substring_index(record_or_head, END, 1)
    return F.nullif(F.regexp_extract(head, rf"\r\n(?i:{name}):[ \t]*([^\r\n]*)", 1), F.lit(""))


def _written(rec: Column) -> Column:
    return F.substr(rec, F.locate(END, rec) + len(END))


def block_of(rec: Column) -> Column:
    plain = header(rec, "Content-Transfer-Encoding").isNull()
    return F.when(plain, _written(rec)).otherwise(F.decode(F.unbase64(_written(rec)), "UTF-8"))


def response_record(url: Column, html: Column, key: Column, date: str = DATE) -> Column:
    """The response record of a page: HTTP status and headers, then the HTML as payload."""
    body = F.coalesce(html, F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)
    head = fields(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", record_id(F.lit("response"), key, url, body)), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.nullif(one_line(url), F.lit(""))),
        ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", F.lit("application/http; msgtype=response")),
    )
    return record(head, http)


#: Names of entities and their signs, those first that most pages hold: a name is looked for in this order.
NAMES = {n: " " if n == "nbsp" else chr(name2codepoint[n]) for n in [*"amp quot nbsp lt gt middot copy".split(), *name2codepoint]}


def numbered(name: Column) -> Column:
    """The sign of `#233` or `#xE9`; null where the number is none of a character."""
    digits = F.regexp_extract(name, r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})$", 1)
    number = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).when(digits != "", digits).cast("long")
    fits = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def resolved(text: Column) -> Column:
    """Every entity of a text resolved once: by number, or by the standard's names; what is none stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def one(part: Column, at: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        sign = F.when(F.octet_length(name) == F.octet_length(part), None).when(F.startswith(name, F.lit("#")), numbered(name)).otherwise(F.try_element_at(known, name))
        return F.when(at == 0, part).otherwise(F.coalesce(F.concat(sign, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def bare_text(html: Column) -> Column:
    """HTML without comments, scripts, styles and tags; block ends are line ends."""
    t = F.regexp_replace(html, r"(?s)<(?:!--.*?-->|(?i:(script|style|head)\b[^>]*>.*?</\1\s*>))", " ")
    t = F.regexp_replace(t, r"<(?i:/?(?:br|p|div|h[1-6]|li|tr|article|nav|footer|title)\b)[^>]*>", "\n")
    return F.regexp_replace(t, r"<[^>]*>", "")


def folded(text: Column) -> Column:
    """Runs of blanks are one blank, blanks and breaks around a break one break. Reads its column several times, so let
    that be a column of a frame."""
    blanks = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\f")]
    t = F.when(blanks[0] | blanks[1] | blanks[2] | blanks[3], F.regexp_replace(text, r"[ \t\r\f]{2,}|[\t\r\f]", " ")).otherwise(text)
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda line: F.trim(line)), lambda line: line != ""), "\n")


def derive(responses: DataFrame, record_col: str = "record") -> DataFrame:
    """Per response: response_id, target_uri, metadata, conversion (whole records) and what they are linked by."""
    rec = F.col(record_col)
    http = block_of(rec)
    df = responses.withColumns({"_http": http, "_html": _written(http), "response_id": header(rec, "WARC-Record-ID"), "target_uri": header(rec, "WARC-Target-URI"), "_date": header(rec, "WARC-Date"), "payload_digest": header(rec, "WARC-Payload-Digest")})
    df = df.withColumns({
        "_bare": bare_text(F.col("_html")),
        "links": F.regexp_extract_all(F.col("_html"), F.lit(r"<[aA]\b[^>]*?\b(?i:href)\s*=\s*[\"']([^\"'>]*)[\"']"), F.lit(1)),
        "title": F.regexp_replace(F.regexp_extract("_html", r"(?s)<(?i:title)\b[^>]*>(.*?)</(?i:title)\s*>", 1), r"\s+", " "),
        "html_lang": F.regexp_extract("_html", r"<(?i:html)\b[^>]*?\b(?i:lang)\s*=\s*[\"']([^\"'>]*)[\"']", 1),
        "metadata_id": record_id(F.lit("metadata"), F.col("response_id")),
        "conversion_id": record_id(F.lit("conversion"), F.col("response_id")),
    })
    df = df.withColumn("_plain", resolved(F.col("_bare"))).withColumn("text", folded(F.col("_plain")))
    source = F.substring_index(F.col("_http"), END, 1)
    # All header lines after the status line, each named a source's: no line is cut out and none is counted.
    lines = F.substr(source, F.locate(CRLF, source) + len(CRLF))
    kept = F.when(F.contains(source, F.lit(CRLF)), F.concat(F.lit("source-header: "), F.replace(lines, F.lit(CRLF), F.lit(f"{CRLF}source-header: "))))
    plain = F.array_join("links", f"{CRLF}outlink: ")
    broken = F.array_join(F.transform("links", one_line), f"{CRLF}outlink: ")
    outlinks = F.when(F.size("links") > 0, F.concat(F.lit("outlink: "), F.when(F.array_join("links", "").rlike(r"[\r\n]"), broken).otherwise(plain)))
    body = F.concat_ws(CRLF, F.concat(F.lit("source-status: "), F.substring_index(source, CRLF, 1)), kept, F.concat(F.lit("title: "), one_line(F.col("title"))), F.concat(F.lit("language: "), one_line(F.col("html_lang"))), outlinks)

    def linked(kind: str, own: str, block: Column, content: str, *more: tuple[str, Column]) -> Column:
        head = fields(
            ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.col(own)), ("WARC-Date", F.col("_date")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("response_id")),
            ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("_date")), *more, ("WARC-Source-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(block)), ("Content-Type", F.lit(content)),
        )
        return record(head, block)

    df = df.withColumn("_fields", body)
    return df.withColumns({"metadata": linked("metadata", "metadata_id", F.col("_fields"), "application/warc-fields"), "conversion": linked("conversion", "conversion_id", F.col("text"), "text/plain", ("WARC-Concurrent-To", F.col("metadata_id")))}).drop("_http", "_html", "_bare", "_plain", "_date", "_fields", "html_lang")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """records: one string column of whole records. gzip and deflate compress at their fastest level."""
    records.write.option("lineSep", END).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record: every record of the files, without its end. Lines are cut where a record can begin."""
    raw = spark.read.option("lineSep", END + FIRST).text(path)
    begun = F.when(F.col("value").startswith(FIRST), F.col("value")).otherwise(F.concat(F.lit(FIRST), F.col("value")))
    ended = raw.select(begun.alias("record"))
    head = F.substring_index("record", END, 1)
    spare = F.octet_length("record") - F.octet_length(head) - len(END) > header(F.col("record"), "Content-Length").cast("long")
    return ended.select(F.when(spare, F.left(F.col("record"), F.length("record") - len(END))).otherwise(F.col("record")).alias("record"))
