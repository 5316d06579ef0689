"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one ``metadata`` and one ``conversion`` record.  Both refer to the response by
``WARC-Refers-To`` and to each other by ``WARC-Concurrent-To``, and keep its target, date and
payload digest; the metadata block keeps the source's HTTP headers.  Identifiers are derived from
the response's, so a second run gives the same records.  Digests are SHA-256 of the block.

Every step is one expression per row; there is no shuffle.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Named character references: those of HTML 4, and the apostrophe.  The usual ones are found first.
USUAL = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "apos": "'"}
ENTITIES = USUAL | {name: chr(code) for name, code in name2codepoint.items()}
#: A reference is no longer than this, its semicolon counted.
LONGEST_REFERENCE = 40
#: Removed with their content, turned into line ends, and removed; in this order.
MARKUP = (
    (r"(?is)<(?:!--.*?-->|(script|style|noscript|template)(?:[\s/][^>]*)?>.*?</\1\s*>)", ""),
    (r"(?i)</?(?:p|br|hr|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|title|blockquote|pre)(?:[\s/][^>]*)?>", "\n"),
    (r"<[/!?a-zA-Z][^>]*>", ""),
)
#: Runs of blanks; a single blank stays without being matched.
SPACES = ((r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " "), (r" ?\n[ \n]*", "\n"))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _referenced(name: Column) -> Column:
    """The character of a reference without ``&`` and ``;``; NULL if there is none of this name."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    digits = F.regexp_extract(name, "^#0*([0-9]{1,7})$", 1)
    hexadecimal = F.regexp_extract(name, "^#[xX]0*([0-9A-Fa-f]{1,6})$", 1)
    code = F.when(digits != "", digits).when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).cast("long")
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(F.startswith(name, F.lit("#")), F.when(good, _char(code))).otherwise(F.try_element_at(named, name))


def _decoded(text: Column) -> Column:
    """Character references decoded once, in one pass; what is no known reference stays as it is.

    ``text`` stands in the result once: the lambda is interpreted, so a second mention would be a
    second evaluation of all that made the text.
    """

    def one(part: Column, i: Column) -> Column:
        end = F.instr(part, ";")
        char = F.when(end.between(2, LONGEST_REFERENCE), _referenced(F.substr(part, F.lit(1), end - 1)))
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(char, F.substr(part, end + 1)), F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(F.split(text, "&", -1), one), "")


def plain_text(html: Column) -> Column:
    """Visible text of a page: markup out, blocks on lines, character references decoded once.

    Null gives the empty text.  Scripts, styles and the like go with their content, up to the
    closing tag of the same name.
    """
    text = F.coalesce(html, F.lit(""))
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    text = _decoded(text)
    for pattern, by in SPACES:
        text = F.regexp_replace(text, pattern, by)
    return F.btrim(text, F.lit(" \n"))


def identifier(seed: Column) -> Column:
    """A record identifier whose 128 bits are the seed's MD5."""
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages; null urls and pages are empty.

    The crawl stores no date, so the caller names one.
    """
    payload, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    length = F.octet_length(payload).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length)
    return pages.select("page_id", "url", "html").select(
        "page_id",
        identifier(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), url, payload)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def derivatives(source: DataFrame, key: str) -> DataFrame:
    """Two records per response: ``key``, record_type, record_id, refers_to, concurrent_to,
    target_uri, date, source_digest, content_type, content_length, block_digest, block.

    ``source`` has the columns of ``responses``; others are left out.  Repeated responses give
    repeated records; null texts count as empty.
    """
    empty = F.lit("")
    field = lambda c: F.coalesce(F.col(c), empty)
    ids = {kind: identifier(F.concat_ws("|", F.lit(kind), field("record_id"))) for kind in ("metadata", "conversion")}
    text = plain_text(F.col("payload"))
    facts = F.concat(
        F.lit("source-payload-digest: "), field("payload_digest"), F.lit(f"{CRLF}source-length: "), F.octet_length(field("payload")).cast("string"),
        F.lit(f"{CRLF}converted-to: "), ids["conversion"], F.lit(CRLF), F.regexp_replace(field("http_headers"), "(?m)^(?=.)", "source-header: "), F.lit(CRLF),
    )
    kinds = F.explode(
        F.array(
            F.struct(F.lit("metadata").alias("kind"), ids["metadata"].alias("id"), ids["conversion"].alias("other"), F.lit("application/warc-fields").alias("type"), facts.alias("block")),
            F.struct(F.lit("conversion").alias("kind"), ids["conversion"].alias("id"), ids["metadata"].alias("other"), F.lit("text/plain; charset=utf-8").alias("type"), text.alias("block")),
        )
    )
    rows = source.select(F.col(key).alias("_key"), field("record_id").alias("refers_to"), field("target_uri").alias("target_uri"), field("date").alias("date"), field("payload_digest").alias("source_digest"), kinds.alias("r"))
    return rows.select(
        F.col("_key").alias(key), F.col("r.kind").alias("record_type"), F.col("r.id").alias("record_id"), "refers_to", F.col("r.other").alias("concurrent_to"),
        "target_uri", "date", "source_digest", F.col("r.type").alias("content_type"), F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"), F.col("r.block").alias("block"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write derivative records as gzipped WARC 1.1 files, one per partition.

    A record ends with two line ends, which is what the text writer puts between rows.
    """
    line = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit(CRLF))).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"), line("WARC-Block-Digest", "block_digest"),
        line("WARC-Refers-To-Payload-Digest", "source_digest"), line("Content-Type", "content_type"), F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit(CRLF * 2),
    )
    records.select(F.concat(head, "block").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
