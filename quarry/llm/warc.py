"""WARC archives: a writer with revisit records for equal payloads, and a splittable reader.

Each record is a gzip member of its own. A reading task has a byte range: it looks for gzip's magic bytes, takes a
candidate for a record only if it decompresses to WARC headers, and owns the records that start inside its range, which
it reads to their end even beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import SALTS, fresh_path, materialize, table

#: Bytes of an archive that a reading task owns.
SPLIT = 4 << 20
#: Payloads below this many bytes are never revisits.
LEAST_PAYLOAD = 0
#: Fixed values of the public formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
_HEAD = 1 << 16


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the response's headers only."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of pages; returns the manifest (path, bytes). Only files that it lists count."""
    data = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), data.alias("payload"), F.unhex(F.sha1(data)).alias("digest"), F.pmod(F.xxhash64(id_col, url_col), F.lit(SALTS)).cast("int").alias("sub"))  # by values: pages are read twice
    # digests first, without payloads; a hot digest is combined by sub-key
    subs = rows.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest", "sub").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    groups = subs.groupBy("digest").agg(F.max(F.struct("top", "sub")).alias("best"), F.sum("n").alias("n"), F.collect_list("sub").alias("subs")).where("n > 1")
    winners = groups.select("digest", F.explode("subs").alias("sub"), F.col("best.top").alias("winner"), F.col("best.sub").alias("place"), F.lit(True).alias("shared"))
    nth = F.row_number().over(Window.partitionBy("digest", "sub").orderBy(F.col("id").desc_nulls_last()))
    judged = rows.join(winners, ["digest", "sub"], "left").withColumn("revisit", F.coalesce(F.col("shared"), F.lit(False)) & ~(F.col("id").eqNullSafe(F.col("winner")) & (F.col("sub") == F.col("place")) & (nth == 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            while first is not None:
                for row in zip(*(first.column(c) for c in ("id", "url", "payload", "digest", "winner", "revisit")), strict=True):
                    page_id, url, payload, digest, winner, revisit = (x.as_py() for x in row)
                    member = record(page_id, url, payload, base64.b32encode(digest).decode(), winner, revisit)
                    out.write(member)
                    size += len(member)
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return materialize(judged.select("id", "url", "payload", "digest", "winner", "revisit").mapInArrow(run, "path string, bytes long"), "archives")


def _headers(raw: bytes) -> dict[str, str] | None:
    """WARC headers at the start of raw, by lower-case name; None if they are not, or not whole."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    out = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        out[name.strip().lower()] = value.strip()
    return out if {"warc-type", "warc-record-id", "content-length"} <= out.keys() and out["content-length"].isdigit() else None


def records(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of an open archive that start at start to end - 1."""
    source.seek(start)
    data, base = bytearray(source.read(end - start + len(MAGIC) - 1)), start

    def member(at: int) -> tuple[bytes, int] | None:
        """The record at offset at and where it ends; None if there is none."""
        press, out, k = zlib.decompressobj(31), [], at - base
        try:
            head = press.decompress(data[k : k + _HEAD], _HEAD)
            if not head.startswith(b"WARC/1.") and len(head) >= 7:
                return None
            out.append(head)
            feed, k = press.unconsumed_tail, min(k + _HEAD, len(data))
            while not press.eof:
                if not feed:
                    if k >= len(data):
                        source.seek(base + len(data))
                        more = source.read(_HEAD)
                        if not more:
                            return None
                        data.extend(more)
                    feed, k = data[k : k + _HEAD], min(k + _HEAD, len(data))
                out.append(press.decompress(feed))
                feed = press.unconsumed_tail
        except zlib.error:
            return None
        return b"".join(out), base + k - len(press.unused_data)

    at = start
    while True:
        k = data.find(MAGIC, at - base)
        if k < 0 or base + k >= end:
            return
        at = base + k
        found = member(at)
        headers = _headers(found[0]) if found else None
        if headers is None:
            at += 1
            continue
        body = found[0].find(b"\r\n\r\n") + 4
        block = found[0][body : body + int(headers["content-length"])]
        if len(block) == int(headers["content-length"]):
            yield at, headers, block
            at = found[1]
        else:
            at += 1


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest is computed from its payload and must be the one in its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                out: dict[str, list] = {c: [] for c in kinds}
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    for at, headers, block in records(source, start, end):
                        body = block.find(b"\r\n\r\n") + 4
                        revisit = headers["warc-type"] == "revisit"
                        payload = block[body:]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: the record at {at} is damaged")
                        length = re.search(rb"(?im)^content-length: *(\d+)", block[:body])
                        for c, v in zip(kinds, (_page(headers["warc-record-id"]), int(length[1]) if revisit else len(payload), digest, headers["warc-type"], _page(headers["warc-refers-to"]) if revisit else None, headers["warc-target-uri"]), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(kinds.items())))

    splits = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split).cast("int"))).alias("k"), "bytes")
    splits = splits.select("path", (F.col("k").cast("long") * split).alias("start"), F.least((F.col("k").cast("long") + 1) * split, "bytes").alias("end"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return splits.repartition(int(n)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as archives in the shared folder and read them back.

    A null html counts as empty; of equal payloads the row with the largest page_id is the response, and of repeated rows
    with that id one. Null ids come last; if all ids of a payload are null, one of its rows is the response and refers_to
    is null. Blanks and control characters in an URL are escaped; a null URL reads as 'urn:none'. An empty table gives no
    rows; other columns are ignored.
    """
    return read_warc(write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc")))
