"""WARC records as gzip members, shard files, and their reading."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa

DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp, so equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, digest: bytes, size: int, refers_to=None) -> bytes:
    """A response (HTTP head and payload) or a revisit (HTTP head only) of a page."""
    block = _HTTP % size + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_b32(digest)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("member", pa.binary())])


def recorder(batches):
    """mapInArrow: page_id, url, html -> every page as a compressed response, with digest and size."""
    for batch in batches:
        ids, urls = batch.column(0), batch.column(1)
        digests, sizes, members = [], [], []
        for i, h in enumerate(batch.column(2)):
            payload = (h.as_py() or "").encode("utf-8", "surrogatepass")
            d = hashlib.sha1(payload)
            digests.append(d.hexdigest())
            sizes.append(len(payload))
            members.append(member(record("response", ids[i].as_py(), urls[i].as_py(), payload, d.digest(), len(payload))))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], schema=RECORDS)


MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def writer(uri: str, roll: int):
    """mapInArrow over rows sorted by shard and page: writes shard files, gives the manifest's rows. A row without a
    record tells that the records of the same page and digest behind it revisit another one.

    A file has a temporary name with the task attempt until it is complete; then it is renamed. A task
    that runs again writes the same bytes under the same final names.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(uri)
        attempt = TaskContext.get().taskAttemptId()
        shard, part, out, name, count, size, sha = None, 0, None, "", 0, 0, None
        mark = head = None

        def close() -> dict:
            out.close()
            store.move(f"{root}/{name}.{attempt}.open", f"{root}/{name}")
            return {"shard": shard, "part": part, "file": name, "records": count, "bytes": size, "sha256": sha.hexdigest()}

        def begin():
            nonlocal out, name, count, size, sha
            name, count, size, sha = f"pages-{shard:06d}-{part:04d}.warc.gz", 0, 0, hashlib.sha256()
            out = store.open_output_stream(f"{root}/{name}.{attempt}.open", compression=None)
            info = b"software: roadlattice\r\nformat: WARC File Format 1.1\r\n"
            put(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))

        def put(data: bytes):
            nonlocal size
            out.write(data)
            sha.update(data)
            size += len(data)

        for batch in batches:
            done = []
            for r in range(batch.num_rows):
                s, is_record, page_id, url, digest, n, data, refers_to = (batch.column(k)[r].as_py() for k in range(8))
                if not is_record:
                    mark, head = (page_id, digest), refers_to
                    continue
                if out is None or s != shard or size >= roll:
                    if out is not None:
                        done.append(close())
                    shard, part = s, (part + 1 if s == shard else 0)
                    begin()
                put(member(record("revisit", page_id, url, b"", bytes.fromhex(digest), n, head)) if mark == (page_id, digest) else data)
                count += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=MANIFEST)
        if out is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=MANIFEST)

    return run


def members(stream, chunk: int = 1 << 20):
    """The unpacked gzip members of a stream, one at a time."""
    data = stream.read(chunk)
    while data:
        z, parts = zlib.decompressobj(31), []
        while True:
            parts.append(z.decompress(data))
            if z.eof:
                data = z.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def parse(data: bytes) -> dict | None:
    """A page's record; None for a warcinfo record. Lengths and digests that don't hold raise ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    f = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    kind, length = f["WARC-Type"], int(f["Content-Length"])
    block = rest[:length]
    if lines[0] != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a record")
    if kind == "warcinfo":
        return None
    number = lambda v: int(v[len("<urn:page:") : -1]) if len(v) > len("<urn:page:>") else None
    size, digest = int(f["WARC-Payload-Length"]), base64.b32decode(f["WARC-Payload-Digest"][5:])
    if _b32(hashlib.sha1(block).digest()) != f["WARC-Block-Digest"]:
        raise ValueError("block digest")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha1(payload).digest() != digest:
            raise ValueError("payload digest")
    return {"page_id": number(f["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest.hex(), "record_type": kind, "refers_to": number(f["WARC-Refers-To"]) if kind == "revisit" else None, "url": f["WARC-Target-URI"]}


def reader(uri: str):
    """mapInArrow: file names -> the records of these files."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = []
                    for data in members(stream):
                        if (row := parse(data)) is not None:
                            rows.append(row)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return run
