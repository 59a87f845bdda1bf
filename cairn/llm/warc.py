"""WARC archives: written compressed by record, read back by boundary-chain verification.

Writing: of pages with equal payloads the one with the largest page_id becomes a response record,
the others revisit records that name it. Each record is a gzip member with the public "sl"
(skip-lengths) extra field: its compressed and uncompressed length.

Reading: files are cut into byte ranges of RANGE, so that records cross them and a file's ranges are
read by many tasks. A task finds every place in its range that looks like the start of a record and
says where that record would end (candidate -> successor): from the "sl" field, else by inflating
the member, and in files that are not compressed from the record's own Content-Length. Magic bytes
may stand inside a payload, so a candidate proves nothing. Inside a range the task follows its own
pointers to where each candidate leaves the range; across ranges pointers are jumped in doubling
steps from the start of each file, and only candidates so reached are records. A second pass walks
each range from its proven entry and checks lengths, CRCs and digests as it reads.

Defined cases: null html is an empty payload (which counts as a payload like any other); a null
page_id is a response only if its payload has no page with an id, and is named by no revisit;
rows equal in page_id and payload are each written, the first of them (all equal) as response and
the rest as revisits of the same id; control characters and blanks of a url are percent-encoded, so
a url can neither end a header nor add one; a payload of any content is written whole, and the
largest must fit in a task's memory; other columns but url are ignored; no pages, no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, text_bytes
from .storage import new_file, open_dir

RANGE, FILE_BYTES, LEVEL = 1 << 20, 64 << 20, 1
#: Ranges that a task reads, where there are more than the cluster has cores.
TASK_RANGES, BLOCK = 32, 1 << 16
#: gzip member with an extra field of one "sl" subfield of eight bytes: fixed values of the public formats.
MAGIC = b"\x1f\x8b\x08\x04"
GZIP, PLAIN = MAGIC[:3], b"WARC/"
_ODD = re.compile("[\x00-\x20\x7f-\x9f\u2028\u2029]")
_HEAD = struct.Struct("<4sIBBH2sHII")
_SUBFIELD = b"sl"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = _HEAD.size + len(body) + 8
    return _HEAD.pack(MAGIC, 0, 0, 255, 12, _SUBFIELD, 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, url: str, page: str, digest: str, payload: bytes, refers: str | None) -> bytes:
    """A response or revisit record with its two trailing line ends; a revisit carries no payload but its length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    url = _ODD.sub(lambda m: quote(m.group()), url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers of a whole record in lower case, with its payload's length and digest: computed, but for a revisit, which declares them.

    The payload is what follows the HTTP header of an HTTP record, and the whole block of any other."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if "http" in h.get("content-type", "") else (b"", b"", block)
    declared = h.get("warc-payload-digest", "")
    if h.get("warc-type") == "revisit":
        size = next((x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
        h["payload_bytes"] = int(size) if size.strip().isdigit() else None
        h["payload_digest"] = declared.partition(":")[2]
    else:
        h["payload_bytes"] = len(payload)
        h["payload_digest"] = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    h["digest_ok"] = not declared.startswith("sha1:") or declared.partition(":")[2] == h["payload_digest"]
    return h


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes pages(page_id, html, optional url) and returns one row per file: (path, size)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "top", "n")
    both = rows.join(first, F.col("digest") == F.col("d"), "left")

    # Repeated rows of the largest id: one of them stays a response. Such rows are few, so only they are numbered.
    twice = cut(rows.join(first, F.col("digest") == F.col("d")).where(F.col("page_id").eqNullSafe(F.col("top"))).groupBy("digest").count().where("count > 1").select("digest"))
    if not twice.isEmpty():
        w = Window.partitionBy("digest", "page_id").orderBy("url")
        dup = both.join(twice.withColumnRenamed("digest", "t"), F.col("digest") == F.col("t"), "left")
        plain = dup.where(F.col("t").isNull() | ~F.col("page_id").eqNullSafe(F.col("top"))).withColumn("again", F.lit(False))
        again = dup.where(F.col("t").isNotNull() & F.col("page_id").eqNullSafe(F.col("top"))).withColumn("again", F.row_number().over(w) > 1)
        both = plain.union(again)
    else:
        both = both.withColumn("again", F.lit(False))
    revisit = F.col("d").isNotNull() & (F.col("again") | ~F.col("page_id").eqNullSafe(F.col("top")))
    out = both.select("page_id", "url", "payload", F.unhex("digest").alias("digest"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), "top")

    def run(batches):
        stream, size, path, done = None, 0, None, []
        for b in batches:
            ids, urls, payloads, digests, kinds, tops = (b.column(i) for i in range(6))
            for i in range(b.num_rows):
                if stream is None:
                    system, path = new_file(folder, "warc.gz")
                    stream, size = system.open_output_stream(path, compression=None), 0
                payload = payloads[i].as_py()
                digest = base64.b32encode(digests[i].as_py()).decode()
                m = member(record(kinds[i].as_py(), urls[i].as_py(), str(ids[i].as_py()), digest, payload, str(tops[i].as_py())))
                stream.write(m)
                size += len(m)
                if size >= FILE_BYTES:
                    stream.close()
                    done.append((path, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "size"])

    return cut(out.mapInArrow(run, "path string, size long"))


def _skip_length(head: bytes) -> int | None:
    """The whole length of a gzip member from its "sl" field, if it has one."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == _SUBFIELD and n == 8 and at + 8 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + n
    return None


def _inflated(f, at: int) -> tuple[bytes, int] | None:
    """(content, length) of the gzip member at a place, its CRC checked; None if there is none."""
    f.seek(at)
    z, out, n = zlib.decompressobj(31), [], 0
    try:
        while not z.eof:
            block = f.read(BLOCK)
            if not block:
                return None
            n += len(block)
            out.append(z.decompress(block))
            if len(out) == 1 and out[0] and not out[0].startswith(PLAIN[: len(out[0])]):
                return None
    except zlib.error:
        return None
    return b"".join(out), n - len(z.unused_data)


def _plain_length(f, at: int) -> int | None:
    """The whole length of an uncompressed record at a place; None if no record's header stands there."""
    size = 1 << 12
    while True:
        f.seek(at)
        data = f.read(size)
        head, end, _ = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        whole = lines if end else lines[:-1]
        if whole and not re.fullmatch(rb"WARC/\d+\.\d+", whole[0]) or any(b":" not in x and x[:1] not in (b" ", b"\t") for x in whole[1:]):
            return None
        if end:
            n = [x.partition(b":")[2].strip() for x in whole[1:] if x.partition(b":")[0].strip().lower() == b"content-length"]
            return len(head) + 4 + int(n[0]) + 4 if n and n[0].isdigit() else None
        if len(data) < size:
            return None
        size *= 4


def _candidates(f, lo: int, hi: int, plain: bool) -> list[tuple[int, int]]:
    """(place, size) wherever a record seems to start in [lo, hi)."""
    f.seek(lo)
    data, magic, out = f.read(max(0, hi - lo) + 64), PLAIN if plain else GZIP, []
    at = data.find(magic)
    while 0 <= at < hi - lo:
        if plain:
            size = _plain_length(f, lo + at)
        else:
            size = _skip_length(data[at : at + 64])
            if size is None:
                size = (_inflated(f, lo + at) or (b"", None))[1]
        if size and size > (0 if plain else 18):
            out.append((lo + at, size))
        at = data.find(magic, at + 1)
    return out


def _leaving(found: list[tuple[int, int]], hi: int) -> list[tuple[int, int]]:
    """Every candidate of a range with the place where its chain leaves the range; chains that meet no record end there."""
    leaves: dict[int, int] = {}
    for at, size in reversed(found):
        leaves[at] = at + size if at + size >= hi else leaves.get(at + size, -1)
    return [(k, v) for k, v in leaves.items() if v >= 0]


def _is_plain(f) -> bool:
    f.seek(0)
    return f.read(len(PLAIN)) == PLAIN


def _exits(folder: str):
    def run(batches):
        system, _ = open_dir(folder)
        for b in batches:
            for path, lo, hi in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with system.open_input_file(path) as f:
                    keep = _leaving(_candidates(f, lo, hi, _is_plain(f)), hi)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(keep), pa.string()), pa.array([k for k, _ in keep], pa.int64()), pa.array([v for _, v in keep], pa.int64())], names=["path", "at", "next"])

    return run


def _entries(pointers: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, lo, hi, entry) of each range that a record starts in, by doubling from the start of each file.

    pointers(path, at, next) leave their range. Reached places double with each round: all that is within 2^k ranges."""
    most = ranges.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    reached = ranges.where("lo = 0").select("path", F.lit(0).cast("long").alias("at"))
    jump, span = pointers, 1
    while span < most:
        step = reached.join(jump.withColumnsRenamed({"path": "p", "at": "a"}), (F.col("path") == F.col("p")) & (F.col("at") == F.col("a"))).select("path", F.col("next").alias("at"))
        reached = cut(reached.union(step).distinct())
        onward = jump.withColumnsRenamed({"path": "p", "at": "a", "next": "n"})
        jump = cut(jump.join(onward, (F.col("path") == F.col("p")) & (F.col("next") == F.col("a"))).select("path", "at", F.col("n").alias("next")))
        span *= 2
    ends = ranges.withColumnRenamed("path", "p")
    return ends.join(reached, (F.col("p") == F.col("path")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("path", "lo", "hi", F.col("at").alias("entry"))


def _walk(f, path: str, entry: int, hi: int):
    """(place, length, headers) of the records of a range, from its proven entry on."""
    at, plain = entry, _is_plain(f)
    while at < hi:
        f.seek(at)
        head = f.read(64)
        if not head:
            return
        size = _plain_length(f, at) if plain else _skip_length(head)
        if size is None and not plain and head.startswith(GZIP):
            data, size = _inflated(f, at) or (b"", None)
        elif size is not None:
            f.seek(at)
            data = f.read(size)
            if not plain:
                z = zlib.decompressobj(31)
                try:
                    data = z.decompress(data)
                except zlib.error as e:
                    raise ValueError(f"{path}: record at {at} is damaged") from e
                if not z.eof or z.unused_data:
                    raise ValueError(f"{path}: record at {at} is damaged")
        if size is None:
            raise ValueError(f"{path}: no record at {at}")
        yield at, size, parse(data)
        at += size


_RECORD = "path string, at long, size long, record_type string, record_id string, url string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to string"


def _records(folder: str):
    def run(batches):
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _RECORD.split(", ")]
        system, _ = open_dir(folder)
        for b in batches:
            for path, _, hi, entry in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with system.open_input_file(path) as f:
                    out = [(path, at, size, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h["payload_bytes"], h["payload_digest"], h["digest_ok"], h.get("warc-refers-to")) for at, size, h in _walk(f, path, entry, hi)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def ranges_of(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(path, lo, hi, size) of the byte ranges of files(path, size)."""
    n = F.greatest(F.ceil(F.col("size") / range_bytes), F.lit(1)).cast("int")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    step = F.lit(range_bytes).cast("long")
    return ranges.select("path", (F.col("k") * step).alias("lo"), F.least((F.col("k") + 1) * step, F.col("size")).alias("hi"), "size").where("lo < hi")


def read_records(files: DataFrame, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """(path, at, size, record_type, record_id, url, payload_bytes, payload_digest, digest_ok, refers_to) of every record of files(path, size):
    any WARC files, compressed by record or not at all. digest_ok is false where a declared SHA-1 differs from the payload's."""
    ranges = cut(ranges_of(files, range_bytes))
    n = ranges.count()
    tasks = max(1, -(-n // TASK_RANGES), min(n, 2 * files.sparkSession.sparkContext.defaultParallelism))
    pointers = ranges.repartition(tasks, "path", "lo").mapInArrow(_exits(folder), "path string, at long, next long")
    entries = _entries(cut(pointers), ranges)
    return entries.repartition(tasks, "path", "lo").mapInArrow(_records(folder), _RECORD)


def read_warc(files: DataFrame, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page that write_warc() wrote to the listed files."""

    def page(c: str):
        return F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    sound = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": payload digest differs at "), F.col("at"))))
    rows = read_records(files, folder, range_bytes).where(F.col("record_id").startswith("<urn:page:"))
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def archived(pages: DataFrame) -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder)
