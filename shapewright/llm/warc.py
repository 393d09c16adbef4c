"""WARC archives: a writer with revisit records and a salvage reader.

Archives are files of one gzip member per record, in the shared folder. The
reader checks every member (gzip checksum, record header, Content-Length,
payload digest). After a failed check it searches for the next valid gzip
member - or, in uncompressed archives, the next version line - goes on there,
and logs the bytes between as a quarantined gap."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import each, materialise, new_dir

VERSION = b"WARC/1.1"
LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
MAGIC = b"\x1f\x8b\x08"
#: Bytes after which the writer begins another archive.
ROLL = 64 << 20
#: Tasks that read archives, for each core, at most; a task reads the archives it is dealt one by one.
TASKS_A_CORE = 16
#: Bytes read from an archive at a time.
READ = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case, without padding (a SHA-1 needs none)."""
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url, payload: bytes, payload_digest: str, refers_to=None) -> bytes:
    """One uncompressed record. The id, length and digest of the payload are in
    the header; a revisit has no block."""
    block = payload if kind == "response" else b""
    clean = lambda x: str(x).replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\0{url}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    head += [("X-Page-Id", page_id)] * (page_id is not None) + [("WARC-Target-URI", clean(url))] * (url is not None)
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers_to)]
    head += [("Content-Length", len(block))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0):
    """(header, block, end) of the record at ``at``, or None if its checks fail.
    ``header`` has lower-case names; end is after the record's two blank lines."""
    stop = raw.find(b"\r\n\r\n", at) if raw.startswith(b"WARC/", at) else -1
    if stop < 0 or not LINE.match(raw, at):
        return None
    head = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    block = raw[begin:end]
    if len(block) < int(length) or raw[end : end + 4] != b"\r\n\r\n":
        return None
    said = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and said.startswith("sha1:") and digest(block) != said[5:]:
        return None
    return head, block, end + 4


class Window:
    """A file as a byte string of which only what is asked for is held."""

    def __init__(self, file, step: int = READ):
        self.file, self.step, self.start, self.data, self.done = file, step, 0, b"", False

    def more(self) -> bool:
        got = b"" if self.done else self.file.read(self.step)
        self.done = self.done or not got
        self.data += got
        return bool(got)

    def drop(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at

    def find(self, what: bytes, at: int) -> int:
        """The next place of ``what`` from ``at`` on, or -1; what lies before is dropped."""
        while True:
            if (k := self.data.find(what, at - self.start)) >= 0:
                return k + self.start
            at = max(at, self.start + len(self.data) - len(what) + 1)
            self.drop(at)
            if not self.more():
                return -1


def member(window: Window, at: int):
    """(bytes, end) of the gzip member at ``at``, or None if it is damaged or cut short."""
    import zlib

    unzip, out, k = zlib.decompressobj(31), [], at
    try:
        while not unzip.eof:
            if k >= window.start + len(window.data) and not window.more():
                return None
            part = window.data[k - window.start : k - window.start + window.step]
            out.append(unzip.decompress(part))
            k += len(part)
    except zlib.error:
        return None
    return b"".join(out), k - len(unzip.unused_data)


def salvage(file, compressed: bool = True, step: int = READ):
    """("record", header, block) and ("gap", from, to) of an archive, in order.

    Holds one record at a time. A gap begins where a check failed and ends at
    the next record whose checks all hold, or at the file's end."""
    window, at, gap = Window(file, step), 0, None
    mark = MAGIC if compressed else b"WARC/"
    while True:
        while at >= window.start + len(window.data) and window.more():
            pass
        if at >= window.start + len(window.data):
            break
        got = None
        if compressed:
            if (whole := member(window, at)) and (one := parse(whole[0])) and one[2] == len(whole[0]):
                got = one[0], one[1], whole[1]
        else:
            while (one := parse(window.data, at - window.start)) is None and _open(window, at, step) and window.more():
                pass
            if one:
                got = one[0], one[1], one[2] + window.start
        if got:
            if gap is not None:
                yield "gap", gap, at
                gap = None
            yield "record", got[0], got[1]
            at = got[2]
            window.drop(at)
            continue
        gap = at if gap is None else gap
        nxt = window.find(mark, at + 1)
        if nxt < 0:
            at = window.start + len(window.data)
            break
        at = nxt
    if gap is not None:
        yield "gap", gap, at


def _open(window: Window, at: int, step: int) -> bool:
    """Whether the uncompressed record at ``at`` may only lack bytes not yet read."""
    if window.done or not b"WARC/".startswith(window.data[at - window.start : at - window.start + 5]):
        return False
    stop = window.data.find(b"\r\n\r\n", at - window.start)
    if stop < 0:
        return len(window.data) - (at - window.start) < 1 << 16
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", window.data[at - window.start : stop + 2])
    return bool(m) and len(window.data) < stop + 8 + int(m[1])


def _files(path: str):
    """(file system, path) of a path or URI, for any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with payload_digest, payload_bytes and
    refers_to: the smallest page_id of the pages with the same payload of at
    least ``at_least`` bytes, null for that page itself."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    ids = materialise(keyed.where(F.col("payload_bytes") >= at_least).select("page_id", "sha", "payload_bytes"), "payloads")
    copies = ids.groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialise(copies, "copies")
    # both sides exchanged: AQE splits the pages of a frequent payload
    later = ids.join(copies, ["sha", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = materialise(later.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to").distinct(), "later")
    return keyed.join(later, keyed.page_id.eqNullSafe(later.p) & (keyed.sha == later.s), "left").drop("p", "s")


def write_archives(pages: DataFrame, path: str, at_least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` to archives under
    ``path``; returns the manifest (archive, n_records, n_bytes).

    Null html is an empty payload; null ids and urls leave their header out.
    Pages with equal payloads of at least ``at_least`` bytes refer to the one
    with the smallest id (a null id comes last); rows that repeat that id are
    responses too. Other columns, whatever their names, are not read. A payload
    is held whole while its record is written, and nothing else of its size. Each task attempt writes files of its own, and the manifest
    lists those of the attempts that counted: a lost executor's are ignored."""
    rows = revisits(pages, at_least)

    def run(batches):
        import gzip

        import pyarrow as pa

        store, folder = _files(path)
        store.create_dir(folder, recursive=True)
        out, name, size, n, made = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(each(batch.column(i)) for i in range(4))):
                payload = (html or "").encode()
                raw = record("response" if refers_to is None else "revisit", page_id, url, payload, digest(payload), refers_to)
                if out is None:
                    name, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = gzip.compress(raw, 6, mtime=0)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    out.close()
                    made.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n, size))
        columns = [list(x) for x in zip(*made)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array([x.rpartition("/")[2] for x in columns[0]], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["archive", "n_records", "n_bytes"])

    return materialise(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame, path: str, compressed: bool = True) -> DataFrame:
    """All records and gaps of the archives of ``manifest(archive)`` under ``path``.

    Per record: archive, kind (the WARC-Type), page_id, url, payload_bytes,
    payload_digest, refers_to and block (empty for revisits); per gap: archive,
    kind 'gap', gap_from and gap_to. Each archive is read by one task as a
    stream, a record at a time."""
    fields = "archive string, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, block binary, gap_from long, gap_to long"

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in fields.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in fields.split(", ")]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
        store, folder = _files(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    for what, a, b in salvage(file, compressed):
                        if what == "gap":
                            rows.append((name, "gap", None, None, None, None, None, None, a, b))
                        else:
                            rows.append((name, a.get("warc-type"), number(a.get("x-page-id")), a.get("warc-target-uri"), number(a.get("x-payload-length")), a.get("warc-payload-digest", "").removeprefix("sha1:"), number(a.get("x-refers-to-page-id")), b, None, None))
                            size += len(b) + 200
                        if size > 8 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    # a number of our own, which adaptive execution keeps; dealt out in turn, so the archives are even over the tasks
    tasks = min(manifest.count(), TASKS_A_CORE * manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("archive").repartition(max(1, tasks)).mapInArrow(run, fields)


def round_trip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: per
    page page_id, payload_bytes, payload_digest, record_type and refers_to.

    Null html and null or repeated ids are treated as ``write_archives`` says;
    an empty table gives an empty result."""
    path = new_dir(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages, path, at_least), path)
    return back.where("kind <> 'gap'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
