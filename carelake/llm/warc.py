"""Derivative builder: WARC responses become linked metadata and plain-text conversion records.

A response is one row: record_id, target_uri, date, http_headers, payload,
payload_digest, headers (its own WARC header fields).  Both derived records refer
to it by WARC-Refers-To, keep its target, its date, its digest and its header
fields, and carry the digest of their own block.  All of it is DataFrame
functions on one row; nothing is shuffled.

A null payload counts as empty, a null target or date is left out of the header;
equal rows give equal records (identifiers come from content); other columns are
not read.  Elements, comments, tags and titles that a page leaves open reach to its
end, so a page of any length is read in linear time; ``<`` before a space or digit is
text.  Line ends in header values become spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements without text of their own, elements that end a line, title and links.  What has no end ends
#: with the page (a link's tag at the next ``<``), so each expression passes over a text once.
_END = r"(?:>|\z)"
HIDDEN = "(?is)" + "|".join([rf"<{x}\b.*?(?:</{x}[ \t\r\n]*>|\z)" for x in ("script", "style", "template")] + [r"<!--.*?(?:-->|\z)"])
BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*"
          + _END)
TAGS = "</?[A-Za-z!?][^>]*" + _END
TITLE = r"(?is)<title\b[^>]*(?:>(.*?)(?:</title|\z)|\z)"
LINK = r"""(?i)<a\b[^<>]*?\bhref[ \t\r\n]*=[ \t\r\n]*["']([^"'<>]*)["']"""
#: A character reference after its ``&``: a decimal or hexadecimal number or a name, to the semicolon.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The names of HTML 4 and ``apos``; a no-break space counts as a space.
NAMES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}


def identifier(*parts: Column) -> Column:
    """A urn:uuid from content, so that a repeated task writes the same record."""
    known = [F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    shaped = F.regexp_replace(F.md5(F.concat_ws("\x1f", *known).cast("binary")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-a$4-$5")
    return F.concat(F.lit("<urn:uuid:"), shaped, F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def unescaped(text: Column) -> Column:
    """Character references by number and name replaced, once and from left to right; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def value(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).cast("int")
        return F.when(ref.startswith("#"), once(number, char)).when(ref != "", F.element_at(names, ref))

    def char(number: Column) -> Column:
        known = F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), 0xFFFD).when(number == 0xA0, 0x20).otherwise(number)
        return F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")

    read = lambda piece: once(F.regexp_extract(piece, REFERENCE, 1), lambda ref: F.coalesce(
        F.concat(value(ref), F.substr(piece, F.length(ref) + 2)), F.concat(F.lit("&"), piece)))
    joined = lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), read), ""))
    return once(text, lambda t: F.when(F.contains(t, F.lit("&")), once(F.split(t, "&"), joined)).otherwise(t))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_text(html: Column) -> Column:
    """Visible text, one line per block element, single spaces."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAKS, "\n"), TAGS, "")
    tidy = F.regexp_replace(F.regexp_replace(unescaped(shown), "[ \t\r\f]+", " "), " ?\n[ \n]*", "\n")
    return F.regexp_replace(tidy, "^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of crawled pages (page_id, url, html), fetched at ``date``."""
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    base = pages.select(
        F.col("page_id"), identifier(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http_headers"), html.alias("payload"),
        digest(html).alias("payload_digest"))
    return base.withColumn("headers", F.map_filter(F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), F.col("record_id"), F.lit("WARC-Target-URI"), F.col("target_uri"),
        F.lit("WARC-Date"), F.col("date"), F.lit("WARC-Payload-Digest"), F.col("payload_digest"),
        F.lit("Content-Type"), F.lit("application/http; msgtype=response")), lambda k, v: v.isNotNull()))


def derive(source: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows per response: its metadata record, then its conversion record; ``keys`` are carried along."""
    payload = F.coalesce("payload", F.lit(""))
    read = source.select(
        *keys, "record_id", "target_uri", "date", "http_headers", "headers", payload.alias("payload"),
        F.coalesce("payload_digest", digest(payload)).alias("source_digest"))
    title = F.trim(F.regexp_replace(unescaped(F.regexp_extract("payload", TITLE, 1)), "[ \t\r\n\f]+", " "))
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    fields = F.concat(
        F.lit("source-content-type: "), F.regexp_extract(F.coalesce("http_headers", F.lit("")), r"(?i)content-type:[ \t]*([^\r\n]*)", 1), F.lit("\r\n"),
        F.lit("title: "), title, F.lit("\r\n"),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "[\r\n]+", " "), F.lit("\r\n"))), ""))
    record = lambda kind, media, block: F.struct(
        F.lit(kind).alias("record_type"), F.lit(media).alias("content_type"), block.alias("block"))
    both = read.withColumn("record", F.explode(F.array(
        record("metadata", "application/warc-fields", fields), record("conversion", "text/plain; charset=utf-8", plain_text(F.col("payload"))))))
    return both.select(
        *keys, "record.record_type", identifier(F.col("record.record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "date", "record.content_type",
        F.octet_length("record.block").cast("long").alias("content_length"), digest(F.col("record.block")).alias("block_digest"),
        "source_digest", F.col("headers").alias("source_headers"), "record.block")


def header(records: DataFrame) -> Column:
    """The WARC header of derived records, source fields last under names of their own."""
    one_line = lambda value: F.regexp_replace(value, "[\r\n]+", " ")
    line = lambda name, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), one_line(value.cast("string")), F.lit("\r\n")))
    kept = F.array_join(F.transform(F.map_entries("source_headers"), lambda e: F.concat(
        F.lit("X-Source-"), one_line(e["key"]), F.lit(": "), one_line(e["value"]), F.lit("\r\n"))), "")
    named = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Digest", "source_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    return F.concat(F.lit("WARC/1.1\r\n"), *[line(n, F.col(c)) for n, c in named], F.coalesce(kept, F.lit("")), F.lit("\r\n"))


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one per partition, by Spark's own text writer."""
    body = records.select(F.concat(header(records), F.col("block")).alias("value"))
    body.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_FIELD = re.compile(r"([^:\r\n]+):[ \t]*([^\r\n]*)")


def _records(raw: bytes):
    at = raw.find(b"WARC/1.")
    while at >= 0:
        end = raw.index(b"\r\n\r\n", at) + 4
        fields = {m[1]: m[2] for m in _FIELD.finditer(raw[at:end].decode("utf-8", "replace"))}
        size = int(fields.get("Content-Length", 0))
        yield fields, raw[end:end + size].decode("utf-8", "replace")
        at = raw.find(b"WARC/1.", end + size)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (headers, block) of uncompressed WARC files; a file is read as a whole, so its size bounds a task."""
    def run(frames):
        import pandas as pd
        for f in frames:
            for raw in f["content"]:
                found = list(_records(raw))
                yield pd.DataFrame({"headers": [h for h, _ in found], "block": [b for _, b in found]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, "headers map<string,string>, block string")
