"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Responses come from WARC files or from a table of pages. Each gives a metadata
record and a conversion record that refer to it, keep its target, date and
digests, and carry digests of their own. Derivatives are column work; records are
written as WARC text by Spark's own writer. Reading, a file's bytes are parted
at each "WARC/1." and joined again until a record has the length that it states,
so a block may hold that line.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_folder, table

VERSION, MARK = "WARC/1.0", "WARC/1."
#: Date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"

#: In this order: parts without text, breaks of blocks, other tags. A part that isn't closed goes on to the end.
_DROP = r"(?is)<!--(?:.*?-->|.*)|<script\b(?:.*?</script\s*>|.*)|<style\b(?:.*?</style\s*>|.*)|<nav\b(?:.*?</nav\s*>|.*)|<noscript\b(?:.*?</noscript\s*>|.*)"
_BREAK = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|title|blockquote|pre)\b[^>]*>"
_TAG = r"<[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_LANG = r"(?i)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)"


#: A reference that is still there when these are replaced, &amp; aside.
_OTHER = "&(?!amp;)(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z])"
_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"


def _unescape(c: Column) -> Column:
    """The common references but &amp; replaced; none of them can begin another reference."""
    for entity, char in ENTITIES[:-1]:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def references(text: Column) -> Column:
    """Text with all character references replaced, numeric or named and closed by a semicolon, once and from left to right.

    A blank that doesn't break becomes a blank. Texts that hold none but &amp;,
    most of them, take a short way. The text is looked at several times, so it
    should be a column.
    """
    named = {k[:-1]: v.replace("\xa0", " ") for k, v in html5.items() if k.endswith(";")}
    # Numbers of control characters mean what they do in the common eight-bit set; others without a character stand for none.
    odd = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0xA0: " "}
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])

    def piece(x: Column) -> Column:
        name = F.regexp_extract(x, _REFERENCE, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.length(name))).try_cast("int")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.coalesce(F.try_element_at(table(odd), number), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd"))
        value = F.when(name.startswith("#"), char).when(name != "", F.try_element_at(table(named), name))
        return F.when(value.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(value, F.substring(x, F.length(name) + 2, F.length(x))))

    parts = F.split(text, "&")
    every = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))
    return F.when(text.rlike(_OTHER), every).otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))


#: Runs of blanks that aren't one space, which would only be replaced by itself.
_RUN, _RUN_IN_LINE = r"[\t\r\n\f ]{2,}|[\t\r\n\f]", r"[\t\r\f ]{2,}|[\t\r\f]"


def stripped(html: Column) -> Column:
    """Visible text before its last references are replaced, a block to a line."""
    c = F.regexp_replace(html, _DROP, " ")
    c = F.regexp_replace(c, _RUN, " ")
    # No tag ends after the last ">", where each "<" would be searched to the end.
    rest = F.substring_index(c, ">", -1)
    tagged = F.left(c, F.length(c) - F.length(rest))
    return _unescape(F.concat(F.regexp_replace(F.regexp_replace(tagged, _BREAK, "\n"), _TAG, ""), rest))


def _folded(c: Column) -> Column:
    c = F.regexp_replace(c, _RUN_IN_LINE, " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def plain_text(html: Column) -> Column:
    """Visible text, a block to a line; runs of blanks folded, no blank lines."""
    return _folded(references(stripped(html)))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*parts: Column) -> Column:
    """A name-based URN, the same in every run."""
    h = F.md5(F.concat_ws("\n", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record_id, target_uri, date, payload, payload_digest and headers of pages (page_id, url, html).

    A null url or page is an empty text. The id depends on page, url and content,
    so repeated rows are the same record. Extra columns are ignored; pages are
    taken whole; an empty table gives an empty result.
    """
    p = pick(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_digest", digest(F.col("payload")))
    ident = record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest"))
    return p.select("page_id", ident.alias("record_id"), "target_uri", F.lit(NO_DATE).alias("date"), "payload", "payload_digest", F.lit("content-type: text/html; charset=utf-8").alias("headers"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each row of responses(): metadata and conversion.

    Columns: page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, source_headers, source_digest, block_digest, content_length
    (bytes) and block. Every response gives both, also one without text.
    Repeated responses repeat their records; an empty table gives an empty result.
    """
    text = found.withColumn("stripped", stripped(F.col("payload"))).withColumn("text", _folded(references(F.col("stripped")))).withColumn("text_digest", digest(F.col("text")))
    ids = text.withColumn("conversion_id", record_id(F.lit("conversion"), F.col("record_id"))).withColumn("metadata_id", record_id(F.lit("metadata"), F.col("record_id")))
    title = F.trim(F.regexp_replace(references(_unescape(F.regexp_extract("payload", _TITLE, 1))), r"[\t\r\n\f ]+", " "))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), title), F.concat(F.lit("language: "), F.lower(F.regexp_extract("payload", _LANG, 1))), F.concat(F.lit("source-length: "), F.octet_length("payload").cast("string")),
        F.concat(F.lit("text-length: "), F.octet_length("text").cast("string")), F.concat(F.lit("links: "), F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref=")).cast("string")),
        F.concat(F.lit("conversion: "), F.col("conversion_id")), F.concat(F.lit("conversion-digest: "), F.col("text_digest")), F.lit(""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = ids.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), F.explode(kinds).alias("r"))
    return out.select(
        "page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", "source_headers", "source_digest", digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def as_warc(records: DataFrame) -> DataFrame:
    """One text column, value: each record without its closing blank lines."""
    head = F.concat_ws(
        "\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("target_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("X-Source-Digest: "), "source_digest"),
        F.concat(F.lit("X-Source-Headers: "), F.regexp_replace("source_headers", r"\r?\n", "; ")), F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n\r\n"), "block").alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derivatives() as WARC files, one for each partition."""
    as_warc(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers (names in lower case, the first of a repeated one), block and wholeness of each record of files' pieces, in order."""
    def parsed(raw: bytes) -> tuple[dict[str, str], int, int | None]:
        """Headers, where the block begins, and its stated length."""
        head, blank, _ = raw.partition(b"\r\n\r\n")
        headers: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon and name.strip():
                headers.setdefault(name.strip().lower(), value.strip())
        size = headers.get("content-length", "")
        return headers, len(head) + len(blank), int(size) if blank and size.isascii() and size.isdigit() else None

    def record() -> tuple[dict[str, str], bytes, bool]:
        body = b"".join(parts)[start:]
        whole = size is not None and len(body) >= size and not body[size:].strip(b"\r\n")
        return headers, body[:size] if whole else body.removesuffix(b"\r\n\r\n"), whole

    file, parts, have, headers, start, size = None, [], 0, {}, 0, None
    for name, piece in pieces:
        piece = MARK.encode() + piece
        if parts and (name != file or size is None or have >= start + size):
            yield record()
            parts = []
        if not parts:
            file, have, (headers, start, size) = name, 0, parsed(piece)
        parts.append(piece)
        have += len(piece)
    if parts:
        yield record()


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, refers_to, target_uri, date, content_type, block_digest, payload_digest, headers (map), block and whole.

    A record has the bytes that its Content-Length states, whatever they hold.
    whole is false where a file ends before that, something follows, or there is
    no length; the block is then what there is. Bytes that aren't UTF-8 are
    replaced in block; content has them as they are. digest_ok tells whether they
    have the block digest that the record states (sha1, sha256 or md5, in base 32
    or hexadecimal); null where it states none, or one of another kind. A file is
    read in one task.
    """
    raw = spark.read.option("lineSep", MARK).text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("piece"))
    # What stands before a file's first version line is no record.
    pieces = raw.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "place").filter("length(piece) > 0").select("file_path", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for headers, block, whole in _records(rows):
            yield pa.RecordBatch.from_arrays([pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary()), pa.array([whole]), pa.array([_has_digest(block, headers.get("warc-block-digest")) if whole else None], pa.bool_())], ["headers", "content", "whole", "digest_ok"])

    rows = pieces.mapInArrow(run, "headers map<string,string>, content binary, whole boolean, digest_ok boolean")
    get = lambda k: F.try_element_at("headers", F.lit(k))
    return rows.select(
        get("warc-type").alias("record_type"), get("warc-record-id").alias("record_id"), get("warc-refers-to").alias("refers_to"), get("warc-target-uri").alias("target_uri"), get("warc-date").alias("date"),
        get("content-type").alias("content_type"), get("warc-block-digest").alias("block_digest"), get("warc-payload-digest").alias("payload_digest"), "headers", F.expr("make_valid_utf8(cast(content AS string))").alias("block"), "content", "whole", "digest_ok",
    )


def _has_digest(block: bytes, stated: str | None) -> bool | None:
    kind, _, value = (stated or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return None
    found = hashlib.new(kind.lower(), block, usedforsecurity=False)
    return value.strip().lower() in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower())


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise ValueError("a chunk is cut")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _http(content: bytes) -> tuple[str, bytes, str]:
    """Header lines, the payload's bytes (without chunks), and its text: content encodings undone, decoded by the charset of the header, of a mark at its start, or of the page, else as UTF-8 or what old browsers took it for."""
    head, blank, body = content.partition(b"\r\n\r\n") if content.startswith(b"HTTP/") or b"\r\n\r\n" in content else (b"", b"", content)
    if not blank:
        head, body = b"", content
    headers = head.decode("utf-8", "replace")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in headers.split("\r\n"))}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    plain = body
    for kind in reversed([k.strip().lower() for k in fields.get("content-encoding", "").split(",") if k.strip()]):
        if kind in ("gzip", "x-gzip"):
            plain = zlib.decompress(plain, 31)
        elif kind == "deflate":
            try:
                plain = zlib.decompress(plain)
            except zlib.error:
                plain = zlib.decompress(plain, -15)
        elif kind != "identity":
            raise ValueError(f"content encoding {kind}")
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.I) or re.search(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", plain[:4096].decode("latin-1"), re.I)
    marks = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
    charset = next((c for m, c in marks if plain.startswith(m)), named[1] if named else "utf-8")
    try:
        text = plain.decode("cp1252" if charset.lower() in ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii") else charset, "strict" if not named and charset == "utf-8" else "replace")
    except (UnicodeDecodeError, LookupError):
        text = plain.decode("cp1252", "replace")
    return headers, body, text


#: Named fields of a record that go on to its derivatives as source headers.
_KEPT = ("warc-ip-address", "warc-warcinfo-id", "warc-concurrent-to", "warc-identified-payload-type")


def http_responses(records: DataFrame) -> DataFrame:
    """The whole response records of read() as responses(), with problem: what keeps a payload from being read, or null.

    Chunks, gzip and deflate are undone and the text is decoded by its charset,
    on the record's own bytes. The payload digest is the source's where it states
    one, else one of the bytes between the HTTP headers and the end, chunks put
    together. headers are the HTTP headers, and of the record's own fields
    address, warcinfo, concurrent records and the payload's identified type. A
    record without HTTP headers is all payload.
    """
    r = records.filter((F.lower("record_type") == "response") & F.col("whole") & F.coalesce("digest_ok", F.lit(True)))
    fields = F.array_join(F.filter(F.array(*[F.concat(F.lit(f"{k}: "), F.try_element_at("headers", F.lit(k))) for k in _KEPT]), lambda x: x.isNotNull()), "\r\n")
    r = r.select("record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit(NO_DATE)).alias("date"), fields.alias("fields"), "payload_digest", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a page at a time, as payloads can be large
                row = b.slice(i, 1)
                problem = None
                try:
                    headers, body, text = _http(row.column("content")[0].as_py())
                except (ValueError, zlib.error) as e:
                    headers, body, text, problem = "", b"", "", str(e) or "unreadable"
                ours = f"sha256:{hashlib.sha256(body).hexdigest()}"
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in ("record_id", "target_uri", "date", "fields", "payload_digest")), *(pa.array([x], pa.string()) for x in (text, headers, ours, problem))], ["record_id", "target_uri", "date", "fields", "stated", "payload", "http", "ours", "problem"])

    found = r.mapInArrow(run, "record_id string, target_uri string, date string, fields string, stated string, payload string, http string, ours string, problem string")
    headers = F.concat_ws("\r\n", F.nullif("http", F.lit("")), F.nullif("fields", F.lit("")))
    return found.select(F.lit(None).cast("long").alias("page_id"), "record_id", "target_uri", "date", "payload", F.coalesce("stated", "ours").alias("payload_digest"), headers.alias("headers"), "problem")


def responses_of(records: DataFrame) -> DataFrame:
    """The responses of read() whose payload could be read (http_responses), as responses()."""
    return http_responses(records).filter("problem IS NULL").drop("problem")


def broken(records: DataFrame) -> DataFrame:
    """The records of read() that aren't whole or don't have the digest that they state, to be counted or mended."""
    return records.filter(~F.col("whole") | ~F.coalesce("digest_ok", F.lit(True)))


def response_records(found: DataFrame) -> DataFrame:
    """responses() as records for write(): HTTP headers and payload in a block."""
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), "headers", F.lit("\r\n\r\n"), "payload")
    none = F.lit(None).cast("string")
    r = found.select(F.lit("response").alias("record_type"), "record_id", none.alias("refers_to"), "target_uri", "date", F.lit("application/http; msgtype=response").alias("content_type"), none.alias("source_headers"), none.alias("source_digest"), block.alias("block"))
    return r.withColumns({"block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as WARC responses in files, read again, and their derivatives."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(response_records(responses(table(spark, sf_dir, "pages"))), path)
    return derivatives(responses_of(read(spark, path))).drop("page_id", "source_headers")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def _sql() -> str:
    def urn(expr: str) -> str:
        return f"regexp_replace(md5({expr}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"

    def unescape(e: str) -> str:
        for a, b in ENTITIES:
            e = f"replace({e}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
        return e

    def sub(e: str, pattern: str, to: str) -> str:
        flags = "".join(f for f in "is" if pattern.startswith("(?") and f in pattern[: pattern.index(")")])
        body = pattern[pattern.index(")") + 1 :] if flags else pattern
        return f"regexp_replace({e}, '{body.replace(chr(39), chr(39) * 2)}', {to}, 'g{flags}')"

    nl, crlf = "chr(10)", "chr(13) || chr(10)"
    shown = sub(sub("payload", _DROP, "' '"), r"[\t\r\n\f ]+", "' '")
    untagged = sub(sub("left(shown, length(shown) - length(rest))", _BREAK, nl), _TAG, "''") + " || rest"
    text = sub(sub(sub(unescape(untagged), r"[\t\r\f ]+", "' '"), r" ?\n[ \n]*", nl), r"^[ \n]+|[ \n]+$", "''")
    title = f"trim(regexp_replace({unescape('regexp_extract(payload, ' + chr(39) + _TITLE + chr(39) + ', 1)')}, '[\\t\\r\\n\\f ]+', ' ', 'g'))"
    lang = "lower(regexp_extract(payload, '" + _LANG.replace("'", "''") + "', 1))"
    fields = f" || {crlf} || ".join([
        f"'title: ' || {title}", f"'language: ' || {lang}", "'source-length: ' || strlen(payload)", "'text-length: ' || strlen(text)",
        r"'links: ' || len(regexp_extract_all(payload, '(?i)<a\b[^>]*\bhref='))", "'conversion: ' || conversion_id", "'conversion-digest: ' || text_digest", "''",
    ])
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
s AS (SELECT *, string_split(shown, '>')[-1] AS rest FROM (SELECT *, {shown} AS shown FROM p)),
r AS (SELECT *, {urn("'response' || chr(10) || page_id || chr(10) || target_uri || chr(10) || payload_digest")} AS refers_to, {text} AS text FROM s),
d AS (SELECT *, 'sha256:' || sha256(text) AS text_digest, {urn("'conversion' || chr(10) || refers_to")} AS conversion_id, {urn("'metadata' || chr(10) || refers_to")} AS metadata_id FROM r),
u AS (
  SELECT page_id, 'metadata' AS record_type, metadata_id AS record_id, refers_to, target_uri, payload_digest, 'application/warc-fields' AS content_type, {fields} AS block FROM d
  UNION ALL
  SELECT page_id, 'conversion', conversion_id, refers_to, target_uri, payload_digest, 'text/plain; charset=utf-8', text FROM d)
SELECT page_id, record_type, record_id, refers_to, target_uri, '{NO_DATE}' AS date, content_type, 'content-type: text/html; charset=utf-8' AS source_headers,
       payload_digest AS source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block
FROM u
"""


QUERIES = {"op2_warc": op2, "warc_read_back": read_back}
ORACLE_SQL = {"op2_warc": _sql(), "warc_read_back": f"SELECT * EXCLUDE (page_id, source_headers) FROM ({_sql()})"}
