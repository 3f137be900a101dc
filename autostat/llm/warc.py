"""Web archives: write records, read them back, and resolve revisits.

Archives are WARC/1.0 files of a folder, written as text files whose line separator is the blank lines between
records, and read as whole files cut by their Content-Length, so a payload may hold anything. A file is what one
task wrote, and is bounded by the size Spark gives a shuffle partition.

`resolved` shuffles headers by payload digest and joins each record to its group's original, the response with the
largest record id; every other record of the group becomes a revisit. `archived` then writes fresh headers, and
payloads of originals only. A digest that holds a third of all rows is reduced to its largest id before the
shuffle, and the join of records to originals has one row per digest on its right side, so a hot digest may be split.

Defined results: a null payload is empty; a null id counts as smaller than every id and its record refers to the
original (or is a response where no id is known); rows that repeat the original's id are responses too; input
revisits without a payload keep the digest of their header, and stay without reference where no response has it;
other columns are ignored; no rows give an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autostat.llm.text import whole

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BLANK = "\r\n\r\n"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four base32 digits."""
    digits = [F.lpad(F.conv(F.substr(F.sha1(payload), F.lit(i), F.lit(5)), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, record_id: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Response records of web pages."""
    body = whole(payload)
    return pages.select(
        F.col(record_id).cast("long").alias("record_id"), whole(uri).alias("uri"), F.lit("response").alias("type"),
        body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"),
        payload_digest(F.encode(body, "utf-8")).alias("digest"),
    )


def resolved(recs: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`recs` with type and refers_to as the digests decide."""
    headers = recs.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
    originals = headers.groupBy("digest").agg(F.max("record_id").alias("original"))
    again = (F.col("payload_bytes") >= least_bytes) & ~F.col("record_id").eqNullSafe(F.col("original"))
    repeats = F.coalesce(again & F.col("original").isNotNull(), F.lit(False))
    return recs.join(originals, "digest", "left").select(
        "record_id", "uri", F.when(repeats, "revisit").otherwise(F.col("type")).alias("type"),
        F.when(~repeats, F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(repeats, F.col("original")).alias("refers_to"),
    )


def urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))


def archived(recs: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write the records, headers fresh, to gzip files below `path`."""
    uri = F.regexp_replace("uri", r"[\x00-\x20\x7f]", "%20")
    response = F.col("type") == "response"
    block = F.when(response, F.concat(F.lit(HTTP_HEAD), whole("payload"))).otherwise(F.lit(HTTP_HEAD))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", urn(F.col("record_id"))),
        F.lit(f"WARC-Date: {date}"), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", urn(F.col("refers_to")))),
        F.when(~response, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    lines = recs.select(F.concat(head, F.lit(BLANK), block).alias("value"))
    lines.write.option("lineSep", BLANK).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file's bytes."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = data.find(b"WARC/1.0\r\n")
    while at >= 0:
        end = data.index(b"\r\n\r\n", at)
        named = (x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        head = {x[0]: x[1] if len(x) > 1 else "" for x in named}
        stop = end + 4 + int(head["Content-Length"])
        yield head, data[end + 4 : stop]
        at = data.find(b"WARC/1.0\r\n", stop, stop + 14)


FIELDS = "record_id long, uri string, type string, payload string, payload_bytes long, digest string, refers_to long"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below `path`. Bytes and digest of a response are taken from its payload, those of a
    revisit from its header. Without `payloads` that column is null."""

    def number(urn_text: str | None) -> int | None:
        found = (urn_text or "").removeprefix("<urn:record:").removesuffix(">")
        return int(found) if found.lstrip("-").isdigit() else None

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                out = []
                for head, block in parsed(data):
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    whole_body = head["WARC-Type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    told = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    if whole_body and told and told != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                    out.append((
                        number(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), head["WARC-Type"],
                        body.decode("utf-8", "replace") if payloads and whole_body else None,
                        len(body) if whole_body else int(head.get("WARC-Payload-Length", 0)),
                        digest if whole_body else told, number(head.get("WARC-Refers-To")),
                    ))
                table = pd.DataFrame(out, columns=[x.split()[0] for x in FIELDS.split(", ")])
                yield table.astype({"record_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(rows, FIELDS)
