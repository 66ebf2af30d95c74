"""WARC archives with a two-level capture index.

write_archive() writes one WARC record per page, each its own gzip member, into files in the shared
folder.  A file carries its task attempt's number, and only rows of attempts that Spark kept name it,
so a lost executor leaves at most a file that nothing points to.

build_index() sorts captures by reversed-host URL key (`net,example,www)/path 000..page`) into range
partitions of bounded number.  Each partition is one file: compressed blocks of sorted lines, then a
sparse directory with the first key, place and length of each block.  find_captures() binary-searches
the partitions' first keys, then the directory, then the lines of one block; read_records() fetches the
byte ranges found, neighbours in one read, and parses the records.

Null html is an empty payload, a null url has the key `-`, a null page_id the stamp `-`.  Of equal payloads
(equal SHA-256 and length) of at least `least` bytes, the one with the largest page_id is the response and the
others revisit it; rows that repeat the largest page_id are all responses.  Repeated rows give a record each.
An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import Stage, small, table

LINES = 512
PARTS = 4096
PER_PART = 20_000
#: The capture date of pages that have none.
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def safe_url(url: str) -> str:
    """White space and control characters, which a header or an index line can't hold, as %XX."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def capture_key(url: str | None, page_id: int | None) -> bytes:
    stamp = "-" if page_id is None else f"{page_id + 2**63:020d}"
    if url is None:
        return f"- {stamp}".encode()
    rest = safe_url(url).partition("://")[2] or safe_url(url)
    host = re.match(r"[^/?#]*", rest)[0]
    return f"{','.join(reversed(host.lower().split('.')))}){rest[len(host):]} {stamp}".encode("utf-8", "surrogatepass")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of a response record, or, with refers_to, of a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe_url(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """The fields of a record.  A response's payload must fit its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: None if name not in fields or fields[name] == "<urn:page:->" else int(fields[name][10:-1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its digest")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"


CDX = "key binary, file string, at long, length long"


def _write(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{root}/{_attempt()}.warc.gz"
        for b in small(batches, "html"):
            keys, ats, sizes = [], [], []
            for row in b.to_pylist():
                if out is None:
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = member(record(row["page_id"], row["url"], row["html"] or b"", row["refers_to"]))
                out.write(data)
                keys.append(capture_key(row["url"], row["page_id"]))
                ats.append(at)
                sizes.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([name] * len(keys)), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], ["key", "file", "at", "length"])
        if out is not None:
            out.close()

    return write


def write_archive(pages: DataFrame, root: str, stage: Stage, least: int = 0) -> DataFrame:
    """Writes pages(page_id: long, url, html) below root; returns key, file, at, length of each record."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("bytes"))
    same = (named.filter(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count("page_id").alias("known"), F.count("*").alias("n"))
            .filter("n > 1 AND last IS NOT NULL AND (first < last OR known < n)").select("sha", "bytes", "last"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = named.join(stage.keep(same), ["sha", "bytes"], "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return stage.keep(rows.mapInArrow(_write(root), CDX))


def _write_index(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, lines, directory = None, 0, f"{root}/{_attempt()}.cdx", [], []

        def flush() -> int:
            data = zlib.compress(b"\n".join(b"\t".join(x) for x in lines))
            out.write(data)
            directory.append(b"\t".join([lines[0][0], b"%d" % at, b"%d" % len(data)]))
            lines.clear()
            return len(data)

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    system, path = _open(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                lines.append((row["key"], row["file"].encode(), b"%d" % row["at"], b"%d" % row["length"]))
                if len(lines) == LINES:
                    at += flush()
        if out is None:
            return
        if lines:
            at += flush()
        sparse = zlib.compress(b"\n".join(directory))
        out.write(sparse + len(sparse).to_bytes(8, "big"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0].split(b"\t")[0]], pa.binary()), pa.array([name])], ["first", "file"])

    return write


def build_index(captures: DataFrame, root: str, stage: Stage) -> list[tuple[bytes, str]]:
    """Writes the index below root; returns first key and file of each partition, PARTS at most."""
    parts = min(PARTS, max(1, -(-captures.count() // PER_PART)))
    # The key ends with the page, so a host with many captures is cut like any other range.
    done = captures.repartitionByRange(parts, "key", "file", "at").sortWithinPartitions("key", "file", "at").mapInArrow(_write_index(root), "first binary, file string")
    return sorted((bytes(r.first), r.file) for r in stage.keep(done).collect())


def _read(uri: str, at: int, length: int) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, at)


class Part:
    """One partition of the index, opened."""

    def __init__(self, uri: str):
        self.system, path = _open(uri)
        self.file = self.system.open_input_file(path)
        end = self.file.size()
        size = int.from_bytes(self.file.read_at(8, end - 8), "big")
        self.directory = [line.split(b"\t") for line in zlib.decompress(self.file.read_at(size, end - 8 - size)).split(b"\n")]
        self.firsts = [d[0] for d in self.directory]
        self.held, self.lines, self.keys = -1, [], []

    def block(self, k: int) -> None:
        if k != self.held:
            _, at, size = self.directory[k]
            self.lines = [line.split(b"\t") for line in zlib.decompress(self.file.read_at(int(size), int(at))).split(b"\n")]
            self.held, self.keys = k, [x[0] for x in self.lines]

    def find(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """File, place and length of every capture with the key."""
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)  # captures of a key may begin in the block before
        while k < len(self.firsts) and self.firsts[k] <= key:
            self.block(k)
            for i in range(bisect.bisect_left(self.keys, key), len(self.keys)):
                if self.keys[i] != key:
                    return
                yield self.lines[i][1].decode(), int(self.lines[i][2]), int(self.lines[i][3])
            k += 1


def find_captures(wanted: DataFrame, parts: list[tuple[bytes, str]]) -> DataFrame:
    """key, file, at, length of the captures of wanted(page_id, url), found through the index."""
    firsts = [k for k, _ in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, to = [], []
            for row in b.to_pylist():
                key = capture_key(row["url"], row["page_id"])
                # A key's captures may straddle partitions.
                a, z = max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)
                keys += [key] * (z - a)
                to += range(a, z)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(keys, pa.binary())], ["part", "key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = -1, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["part"] != number:
                    number, part = row["part"], Part(parts[row["part"]][1])
                out += [(row["key"], *x) for x in part.find(row["key"])]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["key", "file", "at", "length"])

    # Keys of a partition come sorted, so each of its blocks is read once.
    routed = wanted.select("page_id", "url").mapInArrow(route, "part long, key binary").distinct()
    return routed.repartition(len(parts) or 1, "part").sortWithinPartitions("part", "key").mapInArrow(find, CDX)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, payloads: bool = False, most: int = 4_000_000) -> DataFrame:
    """The records at captures(file, at, length).  Ranges that touch are fetched in one read of up to about `most` bytes."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fetch(run: list[dict]) -> pa.RecordBatch:
            at = run[0]["at"]
            data = _read(run[0]["file"], at, run[-1]["at"] + run[-1]["length"] - at)
            found = [parse(zlib.decompress(data[r["at"] - at:r["at"] - at + r["length"]], 31)) for r in run]
            return pa.RecordBatch.from_pylist([{n: f[n] for n in names} for f in found], kinds)

        run: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if run and (row["file"] != run[0]["file"] or row["at"] != run[-1]["at"] + run[-1]["length"] or row["at"] - run[0]["at"] > most):
                    yield fetch(run)
                    run = []
                run.append(row)
        if run:
            yield fetch(run)

    # Stretches of a file go to a task together; a large file is cut.
    stretch = F.floor(F.col("at") / (16 * most))
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as the rows are small and what they point to is not
    return captures.select("file", "at", "length").repartition(tasks, F.col("file"), stretch).sortWithinPartitions("file", "at").mapInArrow(read, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "warc")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    captures = write_archive(pages, f"{stage.root}/archive", stage)
    parts = build_index(captures, f"{stage.root}/index", stage)
    return read_records(find_captures(pages, parts)).drop("url")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, [strpos('0123456789abcdef', sha1(html)[i]) - 1 for i in range(1, 41)] AS h FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((h[(5 * i) // 4 + 1] * 16 + h[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) + 1] for i in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""
