"""Operator 12: a content-addressed archive of web pages, and WARC files from it.

:func:`archive` stores every distinct payload once, under its address (SHA-256), and the head of each record, with SHA-1,
SHA-256 and length of its payload, apart from it. A payload takes no part in any shuffle but for one that many rows share:
groups are found over digests alone, and the rows that are the only or the chosen one of their address are written where
they are. :func:`restored` joins heads and payloads and verifies each payload against both digests and the length.

:func:`write_files` makes WARC/1.1 files of an archive: of records with equal payloads of ``least`` bytes or more, the one
of the largest page id is a response, the others revisit it; smaller payloads are written each time. The text writer puts
the two line ends between records, and may compress a file. :func:`read_files` takes the records from the files by their
Content-Length, one file at a time and a few records at once; :func:`resolved` gives revisits the payload's length and
digest by a join with the responses.

Null html: an empty payload. Null url: no target; a url with blanks, control characters or ``%`` escapes that would break
a header is written in escaped form, which the reader takes back. Null page ids come before all others. Rows that agree in
page id and payload are records of their own; one of them is the response. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.durable import discard, is_small, opened, sized_join, written

#: Payloads of fewer bytes are written in full each time.
LEAST = 1000
#: Fixed value: the profile of revisit records in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
#: Bytes of records that a reading task holds before it sends them on.
HELD = 8 << 20


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, url, date, http, payload): a record of each page, with the head of the answer that it stands for."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(payload), F.lit(END + END))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.lit(date).alias("date"), http.alias("http"), payload.alias("payload"))


def _digested(records: DataFrame) -> DataFrame:
    return records.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "address": F.sha2("payload", 256)})


def archive(records: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(heads, payloads), written to ``folder``: heads (record_id, page_id, url, date, http, bytes, sha1, address, first) has a
    row for each record, ``first`` being the record_id of the response for its payload; payloads (address, payload)
    has each distinct one."""
    spark = records.sparkSession
    seen = _digested(records).drop("payload").withColumn("n", F.monotonically_increasing_id())
    bits = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "address", F.col("n").cast("string")))
    uuid = F.concat_ws("-", *[F.substring(bits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    seen = written(seen.withColumn("record_id", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))).drop("n"), "seen")
    rank = F.struct(F.col("page_id").isNotNull(), F.col("page_id"), F.col("record_id"))
    found = seen.groupBy("address").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("rows"))
    groups = written(found.where("rows > 1").select("address", F.col("top.page_id").alias("top_page"), F.col("top.record_id").alias("top_record")), "groups")
    heads = sized_join(seen, groups, "address", "left").select(seen.columns + [F.coalesce("top_record", "record_id").alias("first")])
    heads.write.parquet(f"{folder}/heads")
    # the payload of a group comes from a row of its top page; where several rows are equal in both, one of them is picked
    top = seen.select("address", "page_id", "record_id").alias("s").join(groups.alias("g"), F.expr("s.address = g.address and s.page_id <=> g.top_page"))
    several = written(top.groupBy("g.address").agg(F.count(F.lit(1)).alias("equal")).where("equal > 1"), "several")
    rows = sized_join(records.select("page_id", "payload").withColumn("address", F.sha2("payload", 256)), groups, "address", "left")
    chosen = rows.where("top_record is null or page_id <=> top_page").select("address", "payload")
    if not several.isEmpty():
        again = sized_join(chosen, several, "address", "left_semi").groupBy("address").agg(F.first("payload").alias("payload"))
        chosen = sized_join(chosen, several, "address", "left_anti").unionByName(again)
    chosen.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    discard(seen, groups, several)
    return opened(spark, f"{folder}/heads"), opened(spark, f"{folder}/payloads")


def _intact(df: DataFrame) -> Column:
    return (F.octet_length("payload") == F.col("bytes")) & (F.sha1("payload") == F.col("sha1")) & (F.sha2("payload", 256) == F.col("address"))


def restored(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records as they were, with ``intact``: whether the payload is there and has both digests and the length. A payload
    that very many records share is one row of the right side, so Spark can split the left."""
    out = heads.join(payloads, "address", "left")
    return out.select("record_id", "page_id", "url", "date", "http", "payload", F.coalesce(_intact(out), F.lit(False)).alias("intact"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _safe(url: Column) -> tuple[Column, Column]:
    """The url as a header can hold it, and how it was escaped (null: not at all)."""
    plain = url.rlike(r"^[\x21-\x7E]+$")
    return F.when(plain, url).otherwise(F.url_encode(url)), F.when(~plain, "form")


def _head(kind: str, block: Column) -> Column:
    target, escape = _safe(F.col("url"))
    lines = [F.lit(f"WARC/1.1{END}WARC-Type: {kind}{END}"), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.col("date")), _field("WARC-Target-URI", target), _field("Target-Escape", escape)]
    lines += [_field("Page-ID", F.col("page_id").cast("string")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _field("Payload-Length", F.col("bytes").cast("string"))]
    if kind == "revisit":
        lines += [_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", F.col("first"))]
    lines += [F.lit(f"Content-Type: application/http; msgtype=response{END}"), _field("Content-Length", F.octet_length(block).cast("string")), F.lit(END)]
    return F.concat(*lines)


def write_files(heads: DataFrame, payloads: DataFrame, folder: str, least: int = LEAST, compression: str = "gzip") -> None:
    """WARC files of the archive's records, in two folders, ``responses`` and ``revisits``. A file holds what one task has: of a table read
    from Parquet, or of a shuffle that Spark has dealt by size."""
    again = (F.col("bytes") >= least) & (F.col("record_id") != F.col("first"))
    options = {"lineSep": END + END, "compression": compression}
    whole = heads.where(~again)
    if is_small(heads):
        whole = F.broadcast(whole)  # payloads stay where they are
    whole = payloads.join(whole, "address")
    block = F.concat(F.col("http").cast("binary"), F.col("payload"))
    whole.select(F.concat(_head("response", block).cast("binary"), block).cast("string").alias("value")).write.options(**options).text(f"{folder}/responses")
    same = heads.where(again)
    same.select(F.concat(_head("revisit", F.col("http")), F.col("http")).alias("value")).write.options(**options).text(f"{folder}/revisits")


FIELDS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "url", "Target-Escape": "escape", "Page-ID": "page", "WARC-Refers-To": "refers_to_record", "WARC-Payload-Digest": "digest"}
_LENGTH = re.compile(rb"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]+)")


def _unpacked(content: bytes, size: int = 1 << 20):
    """The bytes of a file, in pieces; compressed files may have several members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(content), size):
        left = content[at : at + size]
        while left:
            yield member.decompress(left, size)
            left = member.unconsumed_tail
            if member.eof:
                left, member = member.unused_data, zlib.decompressobj(31)
    yield member.flush()


def parsed(content: bytes):
    """(fields, payload) of the records of one file, in order: a record is as long as its Content-Length says, whatever its
    block holds. A file that ends inside a record raises."""
    pieces, held = _unpacked(content), bytearray()

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while more(1):
        end = held.find(b"\r\n\r\n")
        while end < 0 and more(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        length = _LENGTH.search(held, 0, max(end, 0))
        if end < 0 or not held.startswith(b"WARC/1.") or length is None:
            raise ValueError("not a record")
        size = end + 4 + int(length[1])
        if not more(size + 4) or held[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        fields = {}
        for line in held[:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.decode().strip(" \t")
        block = bytes(held[end + 4 : size])
        cut = block.find(b"\r\n\r\n") + 4 if fields.get("content-type", "").startswith("application/http") else 0
        yield fields, block[cut:]
        del held[: size + 4]


READ = "record_type string, record_id string, date string, url string, escape string, page string, refers_to_record string, digest string, found string, bytes long"


def read_files(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all WARC files in the folders of ``folder``: their fields, ``found`` and ``bytes``: SHA-1 and length of the payload that
    was read, and that payload unless it is not asked for."""
    names = list(FIELDS)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, body in parsed(content.as_py()):
                    rows.append([*(fields.get(n.lower()) for n in names), hashlib.sha1(body).hexdigest(), len(body), *([body] if payload else [])])
                    size += len(body) if payload else 500
                    if size > HELD:
                        yield sent(rows)
                        rows, size = [], 0
                yield sent(rows)

    def sent(rows):
        kinds = [*[pa.string()] * (len(names) + 1), pa.int64(), *([pa.binary()] if payload else [])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*FIELDS.values(), "found", "bytes", *(["payload"] if payload else [])])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    out = files.select("content").mapInArrow(run, READ + (", payload binary" if payload else ""))
    return out.withColumn("url", F.when(F.col("escape") == "form", F.url_decode("url")).otherwise(F.col("url"))).drop("escape")


def resolved(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, intact) of records that were read, which are a table: a
    revisit has the length, digest and page of the response it refers to. ``intact``: the digest in the head is that of
    the payload read."""
    said = F.regexp_extract("digest", "^sha1:(.*)$", 1)
    rows = records.select(F.col("page").cast(id_type).alias("page_id"), "url", "record_type", "record_id", "refers_to_record", said.alias("said"), "found", "bytes")
    revisits = rows.where("record_type = 'revisit'")
    responses = rows.where("record_type = 'response'")
    wanted = written(responses.join(revisits.select(F.col("refers_to_record").alias("record_id")).distinct(), "record_id", "left_semi").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("found").alias("payload_digest"), F.col("bytes").alias("payload_bytes")), "referred")
    full = responses.select("page_id", "url", "record_type", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"), F.lit(None).cast(id_type).alias("refers_to"), (F.col("said") == F.col("found")).alias("intact"))
    led = sized_join(revisits.select("page_id", "url", "record_type", "refers_to_record", "said"), wanted, "refers_to_record", "left")
    led = led.select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", F.coalesce(F.col("said") == F.col("payload_digest"), F.lit(False)).alias("intact"))
    return full.unionByName(led)
