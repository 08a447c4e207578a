"""WARC archives of pages: writing with revisit records, and reading by boundary-chain verification.

Archives are written and read by Spark's own text source, whose line separators are a record's end
and a record's first line, so they work on any file system that Spark reaches and large ones split.
In reading, everything that follows a ``WARC/1.1`` line is a candidate record: tasks emit where each
starts and, from its Content-Length, where its successor would. Pointer jumping from each file's
start keeps only reachable candidates, so a ``WARC/1.1`` line inside a payload is payload.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.store import new_path, written

# The format's version line and separators.
MAGIC, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
#: Rows of equal payload are dealt over so many groups; and digests that rows share, up to which they are handed to every task.
SALTS, FEW_DIGESTS = 64, 100_000
RECORDS_PER_FILE = 4000
LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d{1,15})[ \t]*\r\n")
CANDIDATE = (("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("size", pa.int64()), ("head_size", pa.int64()), ("declared", pa.int64()), ("head", pa.string()), ("digest", pa.string()), ("value", pa.string()))
ID_PREFIX = "urn:page:"


def decisions(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest (bare lower-case hex SHA-1), n_bytes, and refers_to: null for a response.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest id is the response; rows of
    that id that repeat are responses as well. Null payloads are empty. Which digests rows share is told by counts that are
    made before the shuffle, of ids and digests alone. If they are few, every task gets them and no payload is moved; else
    payloads meet them by digest, one that many rows share being spread over salted groups.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    long = rows.where(F.col("n_bytes") >= least_bytes)
    shared = written(long.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "shared").select("digest", "first_id")
    if shared.count() <= FEW_DIGESTS:
        joined = rows.join(F.broadcast(shared), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
        spread = shared.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", salt).join(spread, ["digest", "salt"], "left")
    refers = F.when((F.col("n_bytes") >= least_bytes) & (F.col("first_id") != F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", "n_bytes", refers.alias("refers_to"))


def record(kind, page_id, target, digest, n_bytes, refers_to, payload):
    """The text of a record after its version line, up to its closing separator. All arguments are columns."""
    revisit = kind == "revisit"
    uri = lambda i: F.concat(F.lit(f"<{ID_PREFIX}"), i.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", kind), line("WARC-Record-ID", uri(F.coalesce(page_id.cast("string"), F.lit("null")))), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("WARC-Payload-Length", n_bytes.cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(n_bytes).cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(payload))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Writes one record per row below ``path``. Files of ``compression`` none can be split in reading; gzip ones take less room.

    A null payload is an empty response, a null url leaves its header out, a null id is written as such.
    Line feeds in urls are percent-encoded.
    """
    rows = decisions(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    text = record(kind, F.col("page_id"), url, F.col("digest"), F.col("n_bytes"), F.col("refers_to"), F.col("payload"))
    rows.select(text.alias("value")).write.option("lineSep", BREAK).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one task's splits, in order.

    ``horizon`` is the end of the last candidate that lies in no earlier one's payload, so what a payload declares doesn't
    move it. In a file's later splits it can't be told, since a record of an earlier split may reach into them.
    """
    split, at, horizon = None, 0, 0.0
    for batch in batches:
        file, block, seq, value = (c.to_pylist() for c in batch.columns)
        rows = []
        for f, b, n, text in zip(file, block, seq, value, strict=True):
            if (f, b) != split:
                split, at, horizon = (f, b), 0, float("inf") if b else 0.0
            raw = text.encode()
            head = raw.partition(BREAK.encode())[0]
            found = LENGTH.search(b"\r\n" + head + b"\r\n")
            declared, head_size = int(found[1]) if found else None, len(head) + len(BREAK)
            end = head_size + (declared or 0) + len(BREAK)
            exact, inside = declared is not None and len(raw) == end, at < horizon
            if declared is not None and not inside:
                horizon = at + end
            digest = hashlib.sha1(raw[head_size : head_size + declared]).hexdigest() if exact else None
            rows.append((f, b, n, len(raw), head_size, declared, None if declared is None else head.decode(), digest, text if inside or not exact else None))
            at += len(raw) + len(MAGIC)
        columns = list(zip(*rows, strict=True)) or [()] * len(CANDIDATE)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, CANDIDATE, strict=True)], names=[name for name, _ in CANDIDATE])


def candidates(archives: DataFrame) -> DataFrame:
    """What follows each version line, in the order of each file: place, sizes, head, declared length, digest, and text where it may be needed.

    archives: as ``read_text`` gives it. A candidate that ends where the next version line stands, and that lies in no longer
    one's declared payload, goes on with its payload's digest alone. In later splits of a file that can't be told, so there the
    text always goes along.
    """
    schema = "file string, block long, seq long, size long, head_size long, declared long, head string, digest string, value string"
    return archives.select("file", "block", "seq", "value").mapInArrow(_parsed, schema)


def read_text(spark, path: str) -> DataFrame:
    """file, block, seq, value: the archives' text between version lines, in order of (block, seq) within a file."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def reachable(start: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the sorted candidate starts a chain of successors from the first one reaches. Takes log2(n) rounds of jumps.

    A successor at which no candidate stands ends its chain.
    """
    n = len(start)
    at = np.searchsorted(start, successor)
    jump = np.where((at < n) & (start[np.minimum(at, n - 1)] == successor) & (successor > start), at, n) if n else np.zeros(0, dtype=np.int64)
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, dtype=bool)
    seen[:1] = True
    while n:
        fresh = jump[np.flatnonzero(seen)]
        if seen[fresh].all():
            break
        seen[fresh] = True
        jump = jump[jump]
    return seen[:n]


def _records(file: pd.DataFrame) -> pd.DataFrame:
    """The records of one archive from its candidates."""
    file = file.sort_values(["block", "seq"], kind="stable").reset_index(drop=True)
    step = len(MAGIC)
    sizes = file["size"].to_numpy()
    start = np.cumsum(sizes + step) - sizes - 2 * step  # of the version line before each candidate
    real = file["declared"].notna().to_numpy()
    real[:1] = False  # what stands before the first version line
    places = np.flatnonzero(real)
    end = start[places] + step + file["head_size"].to_numpy()[places] + file["declared"].to_numpy()[places].astype(np.int64) + len(BREAK)
    if len(file) and sizes[0]:
        raise ValueError("an archive doesn't begin with a record")
    chain = places[reachable(start[places], end)] if len(places) and places[0] == 1 else places[:0]
    if not len(chain) and len(file) > 1:
        raise ValueError("an archive doesn't begin with a record")
    rows = []
    for k, i in enumerate(chain):
        stop = int(chain[k + 1]) if k + 1 < len(chain) else len(file)
        head, n = file["head"][i], int(file["declared"][i])
        fields = {a.lower(): b for a, b in re.findall(r"(?m)^([\w-]+):[ \t]*(.*?)\r?$", head)}
        digest = file["digest"][i]
        if digest is None or stop > i + 1:
            body = MAGIC.join(file["value"][i:stop]).encode()[int(file["head_size"][i]) :]
            if len(body) != n + len(BREAK):
                raise ValueError("an archive is cut off or a record's length is wrong")
            digest = hashlib.sha1(body[:n]).hexdigest()
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError("a payload doesn't have its record's digest")
        revisit = fields.get("warc-type") == "revisit"
        rows.append((int(start[i]), _id(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), n, fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest, int(fields.get("warc-payload-length", n)) if revisit else n, _id(fields.get("warc-refers-to"))))
    return pd.DataFrame(rows, columns=["offset", "page_id", "record_type", "url", "content_length", "payload_digest", "payload_bytes", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def _id(uri: str | None) -> int | None:
    found = re.fullmatch(f"<{ID_PREFIX}(-?\\d+)>", uri or "")
    return int(found[1]) if found else None


def read_archives(spark, path: str) -> DataFrame:
    """One row per record below ``path``: offset, page_id, record_type, url, content_length, payload_digest, payload_bytes, refers_to.

    An archive that doesn't begin with a record, is cut off or has a payload of another digest raises an error.
    """
    schema = "offset long, page_id long, record_type string, url string, content_length long, payload_digest string, payload_bytes long, refers_to long"
    return candidates(read_text(spark, path)).groupBy("file").applyInPandas(_records, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, written to archives in the shared folder and read back.

    A null payload is an empty response, a null page_id stays null, and rows that repeat are each written and read. Rows
    without an id are responses. An empty table gives an empty result; other columns
    are ignored whatever their names.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
