"""WARC derivatives (operator 4): linked metadata and conversion records for responses.

Each response gives a metadata record (application/warc-fields: title, counts, language, source headers) and a
conversion record (plain text).  Both name the response in WARC-Refers-To, repeat its target URI and date, and carry
its source headers and payload digest besides the digest of their own block.  Record ids are urn:uuid of a digest of
the source id and the record type, so that a run that is repeated names its records alike."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterable, Iterator
from html.entities import name2codepoint
from typing import BinaryIO
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A response without a date takes this one, so that results do not depend on the clock.
EPOCH = "1970-01-01T00:00:00Z"


def urn(*parts: Column) -> Column:
    """urn:uuid of an MD5 over the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


#: A reference after its ampersand; names as in HTML 4, whose code points the standard library lists.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
NAMED = {**name2codepoint, "apos": 39}
#: What separates text from tags: a < that no letter, / or ! follows is text.
TAG = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
LANG = r"""(?is)<html[^>]*[ \t\r\n\f]lang[ \t\r\n\f]*=[ \t\r\n\f]*["']?([^"' \t\r\n\f>]*)"""


def _character(reference: Column, rest: Column) -> Column:
    """The character of a reference with what follows it; null if it names none."""
    named = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])
    hexadecimal = F.conv(F.substring(reference, F.lit(3), F.lit(6)), 16, 10)
    decimal = F.substring(reference, F.lit(2), F.lit(7))
    code = F.when(reference.rlike("^#[xX]"), hexadecimal.cast("int")).when(F.startswith(reference, F.lit("#")), decimal.cast("int")).otherwise(F.try_element_at(named, reference))

    def spelled(c: Column) -> Column:
        valid = c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
        return F.when(valid, F.concat(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"), rest))

    return F.transform(F.array(code), spelled)[0]


def unescaped(text: Column) -> Column:
    """Character references resolved once, a no-break space as a space; what is no reference stays."""

    def piece(p: Column, i: Column) -> Column:
        found = F.transform(F.array(F.regexp_extract(p, REFERENCE, 1)), lambda r: F.when(r != "", _character(r, F.substring(p, F.length(r) + 2, F.length(p)))))
        return F.when(i == 0, p).otherwise(F.coalesce(found[0], F.concat(F.lit("&"), p)))

    whole = lambda t: F.when(F.contains(t, F.lit("&")), F.replace(F.array_join(F.transform(F.split(t, "&"), piece), ""), F.lit("\xa0"), F.lit(" "))).otherwise(t)
    return F.transform(F.array(text), whole)[0]


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)), r"[ \t\r\n\f]+", " "))


def plain_text(html: Column) -> Column:
    """Visible text: comments, scripts and styles go, block ends become line ends, other tags go, references are
    resolved, white space is collapsed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    for tag in ("script", "style", "noscript", "template"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?(?:</{tag}[ \t\r\n\f]*>|\z)", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|hr|/p|/div|/li|/tr|/table|/ul|/ol|/h[1-6]|/title|/section|/article|/nav|/footer|/header)\b[^>]*>", "\n")
    t = unescaped(F.regexp_replace(t, TAG, ""))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n+", "\n"), r"\A[ \n]+|[ \n]+\z", "")


def count_of(html: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(pattern), 0)).cast("long")


def responses(pages: DataFrame, date: str | None = None, headers: str | None = None) -> DataFrame:
    """pages(page_id, url, html) as response records: page_id, record_id, target_uri, date, source_headers, payload,
    source_digest.  A null html is an empty payload, a null url an empty URI.

    `date` and `headers` name columns with what the server sent; without them the date is EPOCH and the headers are
    the three that the payload gives.  The record id is a digest of page id, URI, date and payload, so that two pages
    with one id do not share it."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    made = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    rows = pages.select(
        F.col("page_id").cast("long"),
        url.alias("target_uri"),
        (F.coalesce(F.col(date).cast("string"), F.lit(EPOCH)) if date else F.lit(EPOCH)).alias("date"),
        (F.coalesce(F.col(headers).cast("string"), made) if headers else made).alias("source_headers"),
        html.alias("payload"),
        digest(html).alias("source_digest"),
    )
    return rows.withColumn("record_id", urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("date"), F.col("source_digest")))


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: (page_id, record_type, record_id, refers_to, target_uri, date, content_type,
    source_headers, source_digest, block_digest, block_length, block).

    Nulls were resolved by responses(); a page without text still has both records, the conversion with an empty
    block.  Repeated rows give repeated records with equal ids.  Extra columns are ignored; an empty table gives an
    empty result."""
    source = records.select("page_id", "record_id", "target_uri", "date", "source_headers", "source_digest", "payload", plain_text(F.col("payload")).alias("_text"))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), title_of(F.col("payload"))),
        F.concat(F.lit("lang: "), F.lower(F.regexp_extract("payload", LANG, 1))),
        F.concat(F.lit("links: "), count_of(F.col("payload"), r"(?i)<a[ \t\r\n\f][^>]*href").cast("string")),
        F.concat(F.lit("scripts: "), count_of(F.col("payload"), r"(?i)<script\b").cast("string")),
        F.concat(F.lit("text-bytes: "), F.octet_length("_text").cast("string")),
        F.concat(F.lit("source-digest: "), F.col("source_digest")),
        F.concat(F.lit("source-headers: "), F.regexp_replace("source_headers", "\r\n", " | ")),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(F.col("_fields"), F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    rows = source.withColumn("_fields", fields).withColumn("_r", F.explode(kinds)).select("*", "_r.*")
    return rows.select(
        "page_id",
        "record_type",
        urn(F.col("record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "content_type",
        "source_headers",
        "source_digest",
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("block_length"),
        "block",
    )


HEADERS = (
    ("WARC-Type", "record_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "date"),
    ("Content-Type", "content_type"),
    ("WARC-Block-Digest", "block_digest"),
    ("X-Source-Digest", "source_digest"),
    ("X-Source-Headers", "source_headers"),
)


def _in_line(value: str) -> str:
    """A header's value on one line: control characters and % are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def serialize(row: dict) -> bytes:
    """One gzip member of a WARC 1.1 file."""
    block = row["block"].encode()
    head = "".join(f"{name}: {_in_line(str(row[key]))}\r\n" for name, key in HEADERS if row.get(key))
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", mtime=0)


class Broken(Exception):
    """A compressed file is damaged here; reading goes on behind it."""


class _Inflated(io.RawIOBase):
    """The text of a gzip file of any number of members; behind a damaged one it goes on with the next."""

    MAGIC = b"\x1f\x8b\x08"

    def __init__(self, file: BinaryIO):
        self.file, self.rest, self.member = file, b"", None

    def readable(self) -> bool:
        return True

    def _next_member(self) -> None:
        """Pass over bytes up to what looks like a member's begin."""
        self.member = None
        while (at := self.rest.find(self.MAGIC, 1)) < 0:
            more = self.file.read(1 << 16)
            if not more:
                self.rest = b""
                return
            self.rest = self.rest[-2:] + more
            if self.rest.startswith(self.MAGIC):
                return
        self.rest = self.rest[at:]

    def readinto(self, out) -> int:
        while True:
            if not self.rest:
                self.rest = self.file.read(1 << 16)
                if not self.rest:
                    if self.member is not None:
                        self.member = None
                        raise Broken("the file ends within a member")
                    return 0
            if self.member is None:
                self.member = zlib.decompressobj(31)
            try:
                text = self.member.decompress(self.rest, len(out))
            except zlib.error as e:
                self._next_member()
                raise Broken(str(e)) from None
            if self.member.eof:
                self.rest, self.member = self.member.unused_data.lstrip(b"\0"), None
            else:
                self.rest = self.member.unconsumed_tail
            if text:
                out[: len(text)] = text
                return len(text)


class _Lines:
    """Lines and blocks of a stream; what was read too far is given back."""

    def __init__(self, stream):
        self.stream, self.back = stream, b""

    def line(self) -> bytes:
        at = self.back.find(b"\n")
        if at >= 0:
            line, self.back = self.back[: at + 1], self.back[at + 1 :]
            return line
        held, self.back = self.back, b""
        return held + self.stream.readline()

    def block(self, n: int) -> bytes:
        held, self.back = self.back[:n], self.back[n:]
        return held + (self.stream.read(n - len(held)) if n > len(held) else b"")


#: What a record begins with, behind the end of the one before.
_BEGIN = re.compile(rb"\r\n\r\n(?=WARC/\d)")


def records_of(file: BinaryIO, faults: list[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each whole record of a plain or gzipped WARC file, one record at a time.

    A record whose length is no number, negative or beyond the end of the file, and one in a damaged or cut member, is
    left out, and its fault is added to `faults`; reading goes on with the next record, so none that is whole is lost
    to a bad one before it."""
    faults = [] if faults is None else faults
    start = file.read(2)
    file.seek(0)
    lines = _Lines(io.BufferedReader(_Inflated(file)) if start == b"\x1f\x8b" else file)
    while True:
        try:
            line = lines.line()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := lines.line()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            length = head.get("content-length", "")
            if not re.fullmatch(r"[0-9]{1,18}", length):
                faults.append(f"no length: {length[:40]!r}")
                continue
            block = lines.block(int(length))
            if len(block) < int(length):
                faults.append("the file ends within a record")
                if m := _BEGIN.search(block):
                    lines.back = block[m.end() :]
                continue
        except Broken as e:
            faults.append(str(e))
            lines.back = b""
            continue
        yield head, block


def parse(data: bytes) -> Iterator[dict]:
    """The records of a file that write() made, with the columns of derive()."""
    names = {n.lower(): key for n, key in HEADERS}
    for head, block in records_of(io.BytesIO(data)):
        yield {names[k]: unquote(v) for k, v in head.items() if k in names} | {"block": block.decode()}


def write(records: DataFrame, path: str) -> None:
    """Write derived records as gzipped WARC blocks, one binary row each, to a table at path (any Spark store)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialize(r) for r in batch.to_pylist()], pa.binary())], ["warc"])

    records.select(*[k for _, k in HEADERS], "block").mapInArrow(run, "warc binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of the WARC files at path, as responses() gives them; page_id is null.  Payloads that are
    no UTF-8 have replacement characters, digests are of the text that is kept.  Bad records are left out; faults()
    tells of them."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                for head, block in records_of(io.BytesIO(data.as_py())):
                    if head.get("warc-type") == "response":
                        top, _, payload = block.partition(b"\r\n\r\n")
                        row = [head.get("warc-record-id", ""), head.get("warc-target-uri", ""), head.get("warc-date", EPOCH), top.decode("utf-8", "replace"), payload.decode("utf-8", "replace")]
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["record_id", "target_uri", "date", "source_headers", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, "record_id string, target_uri string, date string, source_headers string, payload string")
    return rows.select(F.lit(None).cast("long").alias("page_id"), "target_uri", "date", "source_headers", "payload", digest(F.col("payload")).alias("source_digest"), "record_id")


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, records, faults, first): of each WARC file at path the whole records, the faulty ones and the first fault."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                found: list[str] = []
                whole = sum(1 for _ in records_of(io.BytesIO(data.as_py()), found))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([whole], pa.int64()), pa.array([len(found)], pa.int64()), pa.array(found[:1] or [None], pa.string())], ["path", "records", "faults", "first"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, records long, faults long, first string")
