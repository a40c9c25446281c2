"""WARC archives with revisit records, and a salvage reader (op2).

Writing: every page is a record, packed as a gzip member of its own into archives of about
``ARCHIVE_BYTES``. Of pages with equal payloads of ``REVISIT_BYTES`` or more, one (the largest
page_id) is written as a response, the others as revisits that name it and carry no payload.
Only ids and digests are shuffled to find it; payloads are written where they are scanned, as long as
the table of repeated digests is known to be small, else salted by page.
Archives go to a folder that all machines share, each under a name of its own task attempt; the
manifest of the attempts that succeeded says which archives count, so a lost executor leaves at
most files that nobody reads. It also says how many records each has: a reader that finds another number fails.

Reading: ``salvage`` walks an archive record by record and checks gzip, version line, header fields,
length and digest. Where a check fails it searches on for the next gzip member or version line at
which a valid record starts, goes on from there and logs the bytes between as a quarantined gap. A
member that breaks, is cut short or holds a bad record is searched in the same way inside, as far as
it could be inflated. Where the next candidate, header end or zero byte lies is remembered, so false starts
that break early cost no rereading; only sound streams nested in broken ones are read more than once.

Defined results: a null html is an empty payload; a null page_id is written as ``null`` and is the
smallest; rows repeated under one page_id are records of their own, one of which is the response;
an empty table gives no archive. Line breaks in urls are percent-encoded. Records have no size limit but memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 1000
VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD_NAME = re.compile(rb"[A-Za-z0-9-]+")
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08(?=[\x00-\x1f])|WARC/1\.[01]\r\n")
#: Repeated digests that are joined where pages are scanned; more of them are joined by shuffling.
BROADCAST_DIGESTS = 500_000
SALTS = 32
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _b32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def encode(fields: dict[str, str], block: bytes) -> bytes:
    """One record: version line, header fields, block. Lengths and digest of the block are added."""
    fields = fields | {
        "WARC-Block-Digest": _b32(hashlib.sha1(block).hexdigest()),
        "Content-Length": str(len(block)),
    }
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class Plain:
    """Records in uncompressed bytes. What has been found out about them is remembered from start to start."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._bad = range(0)  # starts of lines in it lead to a line that is no header field
        self._failed: tuple[int, str, str | None] | None = None  # block that failed

    def decode(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """(fields, block, end) of the record that starts at ``at``, or None if any check fails."""
        raw = self.raw
        m = _VERSION_LINE.match(raw, at)
        if not m or m.end() in self._bad:
            return None
        fields: dict[str, str] = {}
        place = m.end()
        while not raw.startswith(b"\r\n", place):
            end = raw.find(b"\r\n", place)
            name, colon, value = raw[place : max(end, place)].partition(b":")
            try:
                if end < 0 or not colon or not _FIELD_NAME.fullmatch(name):
                    raise ValueError("no header field")
                fields[name.decode("ascii").lower()] = value.decode().strip()
            except ValueError:
                self._bad = range(m.end(), len(raw) + 1 if end < 0 else place + 1)
                return None
            place = end + 2
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()) or not {"warc-type", "warc-record-id"} <= fields.keys():
            return None
        begin, digest = place + 2, fields.get("warc-block-digest")
        stop = begin + int(length)
        if raw[stop : stop + 4] != b"\r\n\r\n" or self._failed == (begin, length, digest):
            return None
        block = raw[begin:stop]
        if digest and digest != _b32(hashlib.sha1(block).hexdigest()):
            self._failed = (begin, length, digest)
            return None
        return fields, block, stop + 4


def decode(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, end) of the record that starts at ``at``, or None if any check fails."""
    return Plain(raw).decode(at)


class Members:
    """Gzip members in an archive."""

    STEP = 1 << 14
    HASHED = 1 << 12

    def __init__(self, raw: bytes):
        self.raw, self._zero = raw, -1
        self.fruitless = -1  # where data begin that gave no record the last time

    def _after_zero(self, at: int) -> int:
        """The place after the next zero byte, beyond the end if there is none."""
        if self._zero < at:
            found = self.raw.find(b"\0", at)
            self._zero = found if found >= 0 else len(self.raw)
        return self._zero + 1

    def _body(self, at: int) -> int | None:
        """Where the deflated data of the member at ``at`` begins; None if its header is unsound.

        So is one with a check of its own that is longer than ``HASHED``: hashing it at every false start before
        the same data would take the square of its length. Names without such a check may have any length.
        """
        raw, flags = self.raw, self.raw[at + 3] if at + 10 <= len(self.raw) else 255
        if flags & 0xE0:
            return None
        place = at + 10
        if flags & 4:
            place += 2 + int.from_bytes(raw[place : place + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                place = self._after_zero(place)
        if flags & 2:
            if place - at > self.HASHED or raw[place : place + 2] != (zlib.crc32(raw[at:place]) & 0xFFFF).to_bytes(2, "little"):
                return None
            place += 2
        return place if place < len(raw) and place != self.fruitless else None

    def inflate(self, at: int) -> tuple[bytes, int | None] | None:
        """(content, end) of the member at ``at``; the end is None if it breaks or is cut short, and the
        content then what came out before. None if nothing comes out."""
        begin = place = self._body(at)
        if place is None:
            return None
        self.fruitless = begin  # until the caller finds a record
        stream, parts = zlib.decompressobj(-15), []
        size = 64
        try:
            while not stream.eof and place < len(self.raw):
                piece = self.raw[place : place + size]
                parts.append(stream.decompress(piece))
                place += len(piece)
                size = min(4 * size, self.STEP)
        except zlib.error:
            content = b"".join(parts)
            return (content, None) if content else None
        content = b"".join(parts)
        if stream.eof:
            place -= len(stream.unused_data)
            trailer = zlib.crc32(content).to_bytes(4, "little") + (len(content) & 0xFFFFFFFF).to_bytes(4, "little")
            if self.raw[place : place + 8] == trailer:
                return content, place + 8
        return (content, None) if content else None


def _plain_records(content: bytes) -> tuple[list[tuple[dict[str, str], bytes]], bool]:
    """The valid records of a member's content, searched as an archive of its own, and whether they fill it."""
    found, sound = [], True
    for kind, _, _, fields, block in salvage(content, members=False):
        if kind == "record":
            found.append((fields, block))
        else:
            sound = False
    return found, sound


def salvage(raw: bytes, members: bool = True) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """(kind, start, end, fields, block) of an archive: ``record`` or quarantined ``gap``.

    Records share the start and end of their member. What is lost inside a complete member is a gap of that
    member's place; a member that breaks gives the records before the break, and its bytes up to the next start
    are a gap.
    """
    plain, packed = Plain(raw), Members(raw)
    at = lost = 0  # next byte to look at, and where the gap under way began
    starts = _START.finditer(raw)
    while at < len(raw):
        start = at
        if not _START.match(raw, at):
            start = next((m.start() for m in starts if m.start() >= at), len(raw))
        if start == len(raw):
            break
        at = start + 1
        found: list[tuple[dict[str, str], bytes]] = []
        sound, end = True, None
        if raw[start] == 0x1F:
            got = packed.inflate(start) if members else None
            if got:
                content, end = got
                found, sound = _plain_records(content)
        elif one := plain.decode(start):
            found, end = [one[:2]], one[2]
        if not found:
            continue
        packed.fruitless = -1
        if lost < start:
            yield "gap", lost, start, {}, b""
        for fields, block in found:
            yield "record", start, start if end is None else end, fields, block
        lost = start
        if end is not None:
            if not sound:
                yield "gap", start, end, {}, b""
            at = lost = end
    if lost < len(raw):
        yield "gap", lost, len(raw), {}, b""


def _repeated(pages: DataFrame, least: int) -> DataFrame:
    """(digest, original, copies): digests that occur more than once, the largest page_id, and its rows."""
    number = F.coalesce("page_id", F.lit(-(1 << 63)))
    ids = pages.where(F.octet_length("payload") >= least).select("digest", "page_id")
    # By digest and page first, so that many copies of one payload are added up before they meet.
    each = ids.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("digest").agg(
        F.sum("n").alias("total"), F.max_by("page_id", number).alias("original"), F.max_by("n", number).alias("copies")
    )
    return groups.where("total > 1").select("digest", "original", "copies")


def prepared(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, record_type, refers_to): which pages are written as revisits.

    Pages meet a table of the repeated digests alone. Where rows repeat under the page_id that is the response, one
    of them is chosen by its url, and the others, which carry no payload, are counted and spelt out again.
    """
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"], pages["url"], payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    groups = common.staged(_repeated(rows, least), "warc-digests")
    if groups.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", salt).join(spread, ["digest", "salt"], "left")
    chosen = F.col("copies").isNotNull() & F.col("page_id").eqNullSafe(F.col("original"))
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))

    def records(joined: DataFrame, revisit, size=F.octet_length("payload").cast("long")) -> DataFrame:
        return joined.select(
            "page_id",
            "url",
            F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
            size.alias("payload_bytes"),
            F.lower(F.hex("digest")).alias("digest"),
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.when(revisit, F.col("original")).alias("refers_to"),
        )

    if not groups.where("copies > 1").take(1):
        return records(joined, revisit)
    tied = chosen & (F.col("copies") > 1)
    of = ["digest", "page_id", "url", "original"]
    counted = joined.where(tied).groupBy(*of).agg(
        F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"), F.first(F.octet_length("payload").cast("long")).alias("size")
    )
    counted = common.staged(counted, "warc-ties")
    first = counted.groupBy("digest").agg(F.min(F.struct(F.col("url").isNotNull(), "url")).getField("url").alias("chosen"))
    counted = counted.join(first, "digest").withColumn("response", F.col("url").eqNullSafe(F.col("chosen")))
    others = F.col("n") - F.col("response").cast("long")
    copies = counted.where(others > 0).select(*of, "size", F.explode(F.sequence(F.lit(1).cast("long"), others)))
    return (
        records(joined.where(~tied), revisit)
        .unionByName(records(counted.where("response"), F.lit(False)))
        .unionByName(records(copies.withColumn("payload", F.lit(b"")), F.lit(True), F.col("size")))
    )


def _id_of(page_id) -> str:
    return "null" if page_id is None or page_id != page_id else str(int(page_id))


def _write_batches(folder: str):
    def run(batches) -> Iterator[pd.DataFrame]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        written: list[tuple[str, int, int]] = []
        held, size, records = [], 0, 0

        def flush() -> None:
            nonlocal held, size, records
            if held:
                name = f"{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}-{len(written)}.warc.gz"
                files.create_dir(base, recursive=True)
                with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(b"".join(held))
                written.append((name, size, records))
            held, size, records = [], 0, 0

        for pdf in batches:
            for page_id, url, payload, n, digest, kind, refers_to in pdf.itertuples(index=False, name=None):
                own = _id_of(page_id)
                fields = {
                    "WARC-Type": kind,
                    "WARC-Record-ID": f"<urn:page:{own}>",
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Target-URI": urllib.parse.quote(url or "", safe="%/:=&?~#+!$,;'@()*[]-._"),
                    "Content-Type": "text/html",
                    "WARC-Payload-Digest": _b32(digest),
                    "X-Payload-Length": str(n),
                }
                if kind == "revisit":
                    fields["WARC-Profile"] = _REVISIT_PROFILE
                    fields["WARC-Refers-To"] = f"<urn:page:{_id_of(refers_to)}>"
                member = gzip.compress(encode(fields, bytes(payload)), 6, mtime=0)
                held.append(member)
                size += len(member)
                records += 1
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        yield pd.DataFrame(written, columns=["archive", "bytes", "records"])

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as from ``prepared``) below ``folder``; the manifest (archive, bytes, records)."""
    manifest = records.select(
        "page_id", "url", "payload", "payload_bytes", "digest", "record_type", "refers_to"
    ).mapInPandas(_write_batches(folder), "archive string, bytes long, records long")
    return common.staged(manifest, "warc-manifest")


_READ_SCHEMA = (
    "archive string, kind string, start long, end long, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, payload binary"
)


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _read_batches(batches) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content, expected in zip(pdf["path"], pdf["content"], pdf["records"], strict=True):
            name, rows, records = os.path.basename(path), [], 0
            for kind, start, end, fields, block in salvage(bytes(content)):
                if kind == "gap":
                    rows.append((name, kind, start, end, None, None, None, None, None, None, None))
                    continue
                records += 1
                digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
                response = fields["warc-type"] == "response"
                rows.append(
                    (
                        name, kind, start, end, _number(fields.get("warc-record-id")),
                        fields.get("warc-target-uri"),
                        len(block) if response else int(fields.get("x-payload-length", 0)),
                        hashlib.sha1(block).hexdigest() if response else digest,
                        fields["warc-type"], _number(fields.get("warc-refers-to")), block,
                    )
                )
                if len(rows) >= 2_000:
                    yield _frame(rows)
                    rows = []
            if expected == expected and expected is not None and records != expected:
                raise ValueError(f"{name}: {records} records could be read of {int(expected)} written")
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ_SCHEMA.split(", ")])
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """All records and gaps of the archives in ``folder`` (of the manifest's archives, if given).

    ``kind`` is ``record`` or ``gap``; ``start`` and ``end`` are byte positions in the archive. Payloads
    of revisits are empty. An archive is read by one task and has about ``ARCHIVE_BYTES``. With a manifest, an
    archive that does not give all of its records ends the job.
    """
    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).option("pathGlobFilter", "*.{warc,warc.gz}").load(folder)
    files = files.select("path", "content")
    if manifest is None:
        files = files.withColumn("records", F.lit(None).cast("long"))
    else:
        name = F.regexp_extract("path", r"[^/]+$", 0)
        files = files.join(manifest.select("archive", "records"), name == F.col("archive")).select("path", "content", "records")
    return files.mapInPandas(_read_batches, _READ_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, read them back, and describe each page's record."""
    pages = common.only(common.read(spark, sf_dir, "pages"), "page_id", "url", "html")
    folder = common.passing_folder(spark, common.new_folder(spark, "warc"))
    manifest = write_archives(prepared(pages), folder)
    if not manifest.where("records > 0").take(1):
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    found = read_archives(spark, folder, manifest).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, max(page_id) AS original, count(*) AS n FROM p
      WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.n > 1 AND p.page_id <> g.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.n > 1 AND p.page_id <> g.original THEN g.original END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
