"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response gives two records that refer to it by its WARC-Record-ID: a metadata record with
the source's HTTP headers, digests and what was found in the page, and a conversion record with
the page's plain text. Records carry their own digests, so both can be checked and traced.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: WARC-Date of the derivatives where the caller gives none: a fixed one, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"
#: Elements without text of their own; those of them whose end tag may not be missing; and those that end a line.
SILENT = frozenset("script style template noscript svg iframe object".split())
RAW = frozenset(("script", "style"))
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
# All quantifiers are possessive: nothing is read twice.
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
QUOTED_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")
CLOSES = {x: re.compile(rf"</{x}(?=[\s/>])", re.IGNORECASE) for x in (*SILENT, "title")}
#: Bytes of blocks in one batch of read_records().
BATCH_BYTES = 8 << 20


@dataclass
class Page:
    title: str | None
    language: str | None
    links: list[str]
    text: str


def unescape(text: str) -> str:
    """Character references as characters; numbers beyond Unicode are the replacement character."""
    return html.unescape(LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def _spaced(text: str) -> str:
    return " ".join(text.split())


def scan(page: str) -> Page:
    """Title, language, links and text of a page in one pass, whose time is in proportion to its length.

    The text's lines end at block elements, its white space is one blank, empty lines go. Broken
    pages are read much as browsers do: a comment, script or style without an end takes the rest
    of the page, other tags without one are left out alone; `<` before anything but a name is
    text. A tag ends at the first `>` outside of quotes; once a quote has no end, tags from
    there on end at the first `>`, and what has none is text.
    """
    title = language = None
    links: list[str] = []
    out: list[str] = []
    unclosed: set[str] = set()
    quotes, at, n = True, 0, len(page)

    def close_of(name: str, start: int) -> int:
        """Where the end tag of an element stands, -1 if nowhere: looked for in vain once a name."""
        if name in unclosed:
            return -1
        found = CLOSES[name].search(page, start)
        if found is None:
            unclosed.add(name)
            return -1
        return found.start()

    while at < n:
        start = page.find("<", at)
        if start < 0:
            out.append(unescape(page[at:]))
            break
        if start > at:
            out.append(unescape(page[at:start]))
        if page.startswith(("<!", "<?"), start):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            if end < 0:
                break
            at = end + (3 if comment else 1)
            out.append(" ")
            continue
        closing = page.startswith("/", start + 1)
        found = NAME.match(page, start + 1 + closing)
        if not found:
            out.append("<")
            at = start + 1
            continue
        end = -1
        if quotes:
            whole = QUOTED_END.match(page, found.end())
            quotes = whole is not None
            end = whole.end() if whole else -1
        if end < 0:
            end = page.find(">", found.end()) + 1
            if not end:
                out.append(unescape(page[start:]))
                break
        at, name = end, found[0].lower()
        if name in BREAKS:
            out.append("\n")
        if closing:
            continue
        if name in SILENT:
            close = close_of(name, end)
            if close >= 0:
                out.append(" ")
                at = page.find(">", close) + 1 or n
            elif name in RAW:
                break
        elif name == "title" and title is None:
            close = close_of(name, end)
            title = _spaced(unescape(page[end:close])) if close >= 0 else None
        elif name == "a" or (name == "html" and language is None):
            wanted = "href" if name == "a" else "lang"
            for x in ATTRIBUTE.finditer(page, found.end(), end - 1):
                if x[1].lower() == wanted:
                    value = _spaced(unescape(x[2] or x[3] or x[4] or ""))
                    if name == "a":
                        links.append(value)
                    else:
                        language = value or None
                    break
    lines = (_spaced(x) for x in "".join(out).split("\n"))
    return Page(title, language, links, "\n".join(x for x in lines if x))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier: a run that is repeated gives the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def found_in(page: Page) -> str:
    """What the metadata record says of a page, a field a line."""
    out = [f"title: {page.title}"] if page.title is not None else []
    out += [f"language: {page.language}"] if page.language else []
    out += [f"outlink: {x}" for x in page.links]
    return "".join(f"{x}\r\n" for x in out)


def record(kind: str, rid: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


COLUMNS = (
    ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("source_headers", pa.string()), ("source_digest", pa.string()), ("content_length", pa.int64()),
    ("block_digest", pa.string()), ("record", pa.binary()),
)
SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, source_headers string, source_digest string, content_length long, block_digest string, record binary"


def derivatives(responses: DataFrame, key: str, date: str = DATE) -> DataFrame:
    """Two rows for each response, a metadata and a conversion record, without a shuffle.

    responses: `key`, record_id, target_uri, http_headers, payload (string), and response_date where
    it is known, which becomes WARC-Refers-To-Date. Null payloads and addresses count as empty;
    a null record_id is derived from the address and the payload. Rows that repeat give records
    with the same identifiers. Other columns are not looked at; pages of any length go through
    whole, in time in proportion to it; an empty table gives no rows.
    """
    fields = responses.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for k, rid, uri, headers, payload, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri, headers, payload = uri or "", headers or "", payload or ""
                data, page = payload.encode("utf-8", "replace"), scan(payload)
                source = digest(data)
                rid = rid or record_id("response", uri, source)
                linked = [("WARC-Refers-To", rid), ("WARC-Target-URI", " ".join(uri.split())), ("WARC-Date", date)]
                linked += [("WARC-Refers-To-Date", known)] if known else []
                about = f"source-payload-digest: {source}\r\nsource-payload-length: {len(data)}\r\n{found_in(page)}"
                about += "".join(f"source-header: {x}\r\n" for x in headers.splitlines() if x)
                for kind, content, block in (
                    ("metadata", "application/warc-fields", about.encode("utf-8", "replace")),
                    ("conversion", "text/plain; charset=utf-8", page.text.encode("utf-8", "replace")),
                ):
                    own = record_id(kind, rid)
                    keys.append(k)
                    whole = record(kind, own, [*linked, ("WARC-Payload-Digest", source), ("Content-Type", content)], block)
                    out.append((kind, own, rid, uri, headers, source, len(block), digest(block), whole))
            columns = list(zip(*out)) if out else [()] * len(COLUMNS)
            arrays = [pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *(n for n, _ in COLUMNS)])

    known = F.col("response_date").cast("string") if "response_date" in responses.columns else F.lit(None).cast("string")
    return responses.select(key, "record_id", "target_uri", "http_headers", F.col("payload").cast("string"), known).mapInArrow(run, f"{key} {fields}, {SCHEMA}")


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html): identifiers come from id and address."""
    length = F.octet_length(F.coalesce("html", F.lit("")))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"))
    h = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)]
    rid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), headers.alias("http_headers"), F.col("html").alias("payload"))


def _records(content: bytes):
    """Fields and block of each record. A length that is missing or no number is what stands before the next
    record; a file that breaks off gives its records up to there, the last one as far as it goes."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    line = b""

    def readline() -> bytes:
        try:
            return stream.readline()
        except (EOFError, OSError, zlib.error):
            return b""

    while line := line if line.startswith(b"WARC/") else readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while line := readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        length, parts = fields.get("Content-Length", ""), []
        if length.isascii() and length.isdigit() and len(length) < 19:
            left = int(length)
            while left > 0:
                try:
                    part = stream.read(min(left, 1 << 20))
                except (EOFError, OSError, zlib.error):
                    part = b""
                if not part:
                    break
                parts.append(part)
                left -= len(part)
        else:
            while (line := readline()) and not line.startswith(b"WARC/"):
                parts.append(line)
        block = b"".join(parts)
        yield fields, block.removesuffix(b"\r\n\r\n") if line.startswith(b"WARC/") else block


def read_records(files: DataFrame) -> DataFrame:
    """path, warc_type, record_id, headers (map), block of every record in WARC files, gzipped or not.

    files is what spark.read.format("binaryFile") gives: path and content, a file a row, which
    bounds a file by 2 GB (WARC files are of about one by custom). Of a field that repeats the
    last stays. Broken files: see _records(). Null or empty contents give no rows.
    """

    def run(batches):
        kind = pa.map_(pa.string(), pa.string())

        def batch_of(rows):
            path, fields, blocks = zip(*rows)
            return pa.RecordBatch.from_pydict(
                {
                    "path": pa.array(path, pa.string()), "warc_type": pa.array([f.get("WARC-Type") for f in fields], pa.string()),
                    "record_id": pa.array([f.get("WARC-Record-ID") for f in fields], pa.string()),
                    "headers": pa.array([list(f.items()) for f in fields], kind), "block": pa.array(blocks, pa.binary()),
                }
            )

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for fields, block in _records(content or b""):
                    rows.append((path, fields, block))
                    held += len(block) + 1024
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("path", "content").mapInArrow(run, "path string, warc_type string, record_id string, headers map<string,string>, block binary")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return derivatives(responses_of_pages(pages), "page_id")
