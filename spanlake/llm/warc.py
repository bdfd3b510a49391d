"""WARC archives as a chunked record table.

A payload is streamed as rows (record id, chunk number) of bounded size, and carries the SHA-1 of its bytes so far from chunk
to chunk. Every such row is a WARC record of its own: the first a response, with the head of an HTTP answer before the payload,
further ones continuations with segment numbers, as the standard has it for long records. Neither writing nor reading holds
more than a chunk of a record beyond the row itself. A record whose payload equals another's is a revisit, which has no block
and names the response.

Archives are gzip files, each with a warcinfo record first, written by Spark's text sink: every record ends with two line ends,
so these are the separator of rows. A file is one gzip member. They are read back with the same separator, in order, and
parsed by Content-Length, so that payloads may contain it.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import id_kind, new_folder, returned, sent, stored

END = "\r\n\r\n"
#: Code points of a chunk; bytes of chunks that a task hands over together.
CHUNK, BATCH = 1 << 15, 1 << 20
#: Bytes from which equal payloads are stored once.
LEAST = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, payload, hash, n): nulls as empty ones but for the id, SHA-256 and bytes of the payload."""
    payload = F.coalesce(pages[payload_col], F.lit(""))
    own = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), payload.alias("payload"))
    return own.withColumns({"hash": F.sha2(F.col("payload").cast("binary"), 256), "n": F.octet_length("payload").cast("long")})


def decide(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, hash, n, refers_to) of all revisits among ``rows``, once each: of equal payloads of at least ``least`` bytes, that
    with the largest id is stored. A null id is less than any other."""
    own = stored(rows.select("id", "hash", "n").where(F.col("n") >= least), "payloads")
    groups = own.groupBy("hash", "n").agg(F.max("id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 and refers_to is not null")
    return own.join(groups.drop("rows"), ["hash", "n"]).where("not (id <=> refers_to)").select("id", "hash", "n", "refers_to").distinct()


def _record(key: str | None, digest: str, chunk: int = 1) -> str:
    """The name of a record: its id, of any characters (none: null), the start of its payload's hash, and the chunk."""
    name = "" if key is None else quote(key, safe="") or "%"
    return f"<urn:page:{name}:{digest[:16]}{'' if chunk == 1 else f':{chunk}'}>"


def _key(record: str) -> str | None:
    name = record.removeprefix("<urn:page:").split(":", 1)[0]
    return None if name == "" else "" if name == "%" else unquote(name)


def _info(date: str) -> str:
    body = "software: spanlake\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}{END}{body}"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """(record): WARC records, a row each, chunks of a payload one after another. ``date``: when the pages were fetched, by
    default now."""
    rows = _rows(pages, id_col, url_col, payload_col)
    to = decide(rows, least).withColumnRenamed("id", "own")
    rows = rows.join(to, (rows["hash"] == to["hash"]) & (rows["n"] == to["n"]) & rows["id"].eqNullSafe(to["own"]), "left").select("id", "url", "payload", rows["hash"], rows["n"], F.col("refers_to").cast("string").alias("refers_to"))
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches):
        import pandas as pd

        out, held, begun = [], 0, False
        for batch in batches:
            for key, url, payload, digest, n, to in zip(batch["id"], batch["url"], batch["payload"], batch["hash"], batch["n"], batch["refers_to"]):
                if not begun:
                    begun = True
                    out.append(_info(date))
                key = None if key is None else str(key)
                so_far = hashlib.sha1()
                target = "".join(c for c in url if c.isprintable() and c != " ")
                revisit, cuts = to is not None and to == to, range(0, max(1, len(payload)), chunk)
                head = f"WARC/1.1\r\nWARC-Target-URI: {target}\r\nWARC-Date: {date}\r\n"
                for k, at in enumerate(cuts, 1):
                    block = payload[at : at + chunk]
                    data = block.encode("utf-8", "surrogatepass")
                    so_far.update(data)
                    held += len(data)
                    if revisit:
                        continue
                    parts = f"WARC-Record-ID: {_record(key, digest, k)}\r\nX-Payload-Digest-So-Far: sha1:{so_far.hexdigest()}\r\n"
                    size = len(data)
                    if k == 1:
                        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}{END}"
                        block, size = http + block, size + len(http)
                        parts += "WARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\n"
                    else:
                        parts += f"WARC-Type: continuation\r\nWARC-Segment-Origin-ID: {_record(key, digest)}\r\n"
                    if len(cuts) > 1:
                        parts += f"WARC-Segment-Number: {k}\r\n"
                    if k == len(cuts):
                        parts += f"X-Payload-Length: {n}\r\n"
                        if k > 1:
                            parts += f"WARC-Segment-Total-Length: {n + len(http)}\r\n"
                    out.append(f"{head}{parts}Content-Length: {size}{END}{block}")
                    if held >= BATCH or len(out) >= 1000:
                        yield pd.DataFrame({"record": out})
                        out, held = [], 0
                if revisit:
                    parts = f"WARC-Record-ID: {_record(key, digest)}\r\nWARC-Type: revisit\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: {_record(to, digest)}\r\nWARC-Payload-Digest: sha1:{so_far.hexdigest()}\r\nX-Payload-Length: {n}\r\n"
                    out.append(f"{head}{parts}Content-Length: 0{END}")
        if out:
            yield pd.DataFrame({"record": out})

    return sent(rows).mapInPandas(work, "record string")


def write(pages: DataFrame, folder: str, **columns) -> None:
    """Archives of all rows of ``pages``, one for each task, in ``folder``."""
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").text(folder)


class _Parser:
    """Records from a stream of pieces, fed chunk by chunk: the digest of a payload's bytes so far goes from one chunk to the next."""

    def __init__(self):
        self.held, self.left, self.headers = b"", 0, None
        self.sha, self.size, self.http = hashlib.sha1(), 0, False

    def feed(self, piece: bytes):
        """Rows (id, chunk, bytes, digest as read, digest as written, type, refers to, total) of chunks that end in ``piece``."""
        self.held += piece
        while True:
            if self.headers is None:
                start = len(self.held) - len(self.held.lstrip(b"\r\n"))
                end = self.held.find(b"\r\n\r\n", start)
                if end < 0:
                    return
                lines = self.held[start:end].decode("utf-8", "surrogatepass").split("\r\n")
                self.headers = dict(x.split(": ", 1) for x in lines[1:])
                self.held, self.left = self.held[end + 4 :], int(self.headers["Content-Length"])
                if self.headers["WARC-Type"] != "continuation":
                    self.sha, self.size, self.http = hashlib.sha1(), 0, self.headers["WARC-Type"] == "response"
            if self.http:  # the head of the HTTP answer isn't payload
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                self.held, self.left, self.http = self.held[end + 4 :], self.left - end - 4, False
            if self.left:
                part = self.held[: self.left]
                self.sha.update(part)
                self.size += len(part)
                self.left -= len(part)
                self.held = self.held[len(part) :]
                if self.left:
                    return
            h, self.headers = self.headers, None
            if h["WARC-Type"] == "warcinfo":
                continue
            to, total = h.get("WARC-Refers-To"), h.get("X-Payload-Length")
            written = (h.get("WARC-Payload-Digest") or h["X-Payload-Digest-So-Far"]).removeprefix("sha1:")
            yield (_key(h.get("WARC-Segment-Origin-ID") or h["WARC-Record-ID"]), int(h.get("WARC-Segment-Number", 1)), self.size, self.sha.hexdigest(), written, h["WARC-Type"], _key(to) if to else None, None if total is None else int(total))


def read_chunks(spark, folder: str) -> DataFrame:
    """(id, chunk, n_bytes, digest, written_digest, kind, refers_to, total): chunk rows of all archives in ``folder``, ids as text.

    n_bytes and digest are those of the payload's bytes up to the end of the chunk, as read; written_digest is what the
    record says. total is in the last chunk of a record and in revisits.
    """
    lines = spark.read.option("lineSep", END).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    columns = ["id", "chunk", "n_bytes", "digest", "written_digest", "kind", "refers_to", "total"]

    def work(batches):
        import pandas as pd

        parser, file = _Parser(), None
        for batch in batches:
            out = []
            for name, value in zip(batch["file"], batch["value"]):
                if name != file:  # an archive is one file, and is read by one task from its start
                    parser, file = _Parser(), name
                out += parser.feed(value.encode("utf-8", "surrogatepass") + END.encode())
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"total": "Int64"})

    return lines.mapInPandas(work, "id string, chunk long, n_bytes long, digest string, written_digest string, kind string, refers_to string, total long")


def read_records(spark, folder: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to), a row for each record, ids as text; a response's chunks are
    checked against their digests, and a mismatch fails."""
    last = read_chunks(spark, folder).where("total is not null")
    good = F.when(F.col("kind") == "revisit", F.lit(True)).otherwise((F.col("digest") == F.col("written_digest")) & (F.col("n_bytes") == F.col("total")))
    digest = F.when(good, F.col("written_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("id", F.lit("without an id")))))
    kind = F.when(F.col("kind") == "revisit", "revisit").otherwise("response")
    return last.select("id", F.col("total").alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type"), "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read their records back, with ids of their own type.

    A null payload is an empty one, a null url an empty one. Rows that share an id give a record each, which revisits what has
    its own payload; of equal payloads, all rows of the largest id are responses. A row without an id revisits like any other,
    and is a response where no row with an id has its payload. An empty table gives no records. Ids are whole numbers or
    strings. Other columns are not read. Where very many rows share a payload, Spark splits the join's skewed partition.
    """
    folder = new_folder(pages.sparkSession, "warc")
    write(pages, folder, id_col=id_col, url_col=url_col, payload_col=payload_col, **options)
    return returned(read_records(pages.sparkSession, folder), id_kind(pages.select(pages[id_col].alias("id")))[0], "refers_to")
