"""WARC archives: payload-deduplicated writing, and reading by boundary-chain verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, arrow_schema, if_small, settle

#: Payloads shorter than this are always written out.
REVISIT_BYTES = 100
#: Size that archives are rotated at.
ARCHIVE_BYTES = 32 << 20
#: Fixed values of the format. Readers take versions 1.0 and 1.1, so what is common to both is what they look for.
MAGIC, VERSIONS = "WARC/1.", "01"
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str, payload_col: str) -> DataFrame:
    """pages with digest, bytes and refers_to (the smallest id with the same payload, for others than that row). Digests are grouped with map-side combining; payloads themselves are not shuffled unless
    the table of repeated digests is too large to broadcast."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    digests = scratch.write(pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")), "digests")
    firsts = digests.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    firsts = scratch.write(firsts.where("n > 1").select("digest", "first_id"), "firsts")
    rows = pages.select(F.col(id_col).alias("id"), *([F.col("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    rows = rows.join(if_small(firsts, firsts.count(), 96), "digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def record_text(urn: str) -> Column:
    """The record of a planned row, without the blank lines that end it. A revisit carries the HTTP head alone."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit(f"<urn:{urn}:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BREAK))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    return F.concat(head, F.when(again, "").otherwise(F.col("payload")))


def rotated(records: DataFrame, size: int) -> DataFrame:
    """(value, archive): the records of each task numbered by archive; one that would grow past `size` is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held = 0, 0
        for batch in batches:
            numbers = []
            for n in pa.compute.binary_length(batch.column("value")).to_pylist():
                n += len(BREAK)
                if held and held + n > size:
                    archive, held = archive + 1, 0
                held += n
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(numbers, pa.int32())], ["value", "archive"])
        settle()

    return records.mapInArrow(run, "value string, archive int")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", urn: str = "page", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row below path, in archives of at most `archive_bytes`, larger records alone.

    Of rows with equal payloads of REVISIT_BYTES or more, that with the smallest id is a response and others are
    revisits of it. Null payloads are empty; a null id is written as the name "null" and never referred to; rows that
    repeat the first row's id are responses, too. An empty table writes no record.
    """
    scratch = Scratch(pages.sparkSession, "warc-plan")
    rows = plan_records(pages, scratch, id_col, payload_col)
    records = rotated(rows.select(record_text(urn).alias("value")), archive_bytes)
    records.write.option("lineSep", BREAK).partitionBy("archive").text(path)
    scratch.drop("digests", "firsts")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, value, head, need): what stands from each occurrence of MAGIC to the next, or to the file's end; seq
    orders a file's pieces. Splits of a file are read by tasks of their own. need: the bytes from the end of MAGIC to the
    end of the record that begins there, by its header; null where none does.

    The first piece of a file is what stands before its first record."""
    pieces = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    # A split's pieces are in order in a partition, and partitions are planned alike for each reading of the same files.
    start = F.col("_metadata.file_block_start")
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.struct(start.alias("block"), F.monotonically_increasing_id().alias("n")).alias("seq"), "value")
    head = F.substring_index("value", BREAK, 1)
    size = F.regexp_extract(head, "(?im)^content-length:[ \\t]*([0-9]{1,18})[ \\t]*\r?$", 1)
    begins = F.col("value").rlike(f"\\A[{VERSIONS}]\r\n") & (F.octet_length(head) < F.octet_length("value")) & (size != "")
    return pieces.withColumns({"head": head, "need": F.when(begins, F.octet_length(head) + 2 * len(BREAK) + F.when(begins, size.cast("long")))})


def chain(lengths: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Of a file's pieces, in order: the record each belongs to, as the index of its first piece, -1 for none; and the
    offset of the first byte that belongs to no record, if any.

    Each piece is a candidate with the offset of its successor. Pointer jumping marks, in rounds that double the
    distance, what the chain from the first record visits; MAGIC inside payloads is not on it. A record that ends where no
    candidate begins breaks the chain.
    """
    n = len(lengths)
    starts = np.cumsum(lengths + len(MAGIC)) - lengths - len(MAGIC)
    end = starts[-1] + lengths[-1]
    # Offsets here are those of what follows each MAGIC; the file's end counts as one more.
    target = np.where(need >= 0, starts + need + len(MAGIC), -1)
    places = np.append(starts, end + len(MAGIC))
    at = np.minimum(np.searchsorted(places, target), n)
    jump = np.append(np.where((need >= 0) & (places[at] == target), at, np.arange(n)), n)
    seen = np.zeros(n + 1, bool)
    seen[min(1, n)] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all():
            break
        seen, jump = more, jump[jump]
    visited = np.flatnonzero(seen[:n])
    record = np.full(n, -1)
    if len(visited):
        record[visited[0] :] = visited[np.searchsorted(visited, np.arange(visited[0], n), "right") - 1]
    if seen[n]:
        return record, None
    record[visited[-1] :] = -1
    return record, int(starts[visited[-1]])


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A row per record of the archives below path: file, offset (of a piece: block and number), type, record_id,
    refers_to, uri, digest and payload. Versions 1.0 and 1.1, plain or, with names that end in .gz, in gzip members.

    Files are read in splits. A first reading takes lengths alone; a file's lengths meet in one task, which keeps what the
    chain from its start reaches (some tens of bytes a record). A second reading gives the records; only those whose
    payload holds the magic, which stand in several pieces, are put together by a shuffle. Blank lines before the first
    record are skipped. What the chain doesn't reach, as a length in a header is wrong or a file is cut, raises an error
    that names file and offset; with strict off the records before it are returned. An empty folder gives no rows.
    """
    scratch = Scratch(spark, "warc-read")
    pieces = candidates(spark, path)
    blank = F.length(F.regexp_replace("value", "[\r\n]", "")) == 0
    told = "file string, seq struct<block: long, n: long>, record struct<block: long, n: long>, broken long"
    into = arrow_schema(told)

    def link(group: pa.Table) -> pa.Table:
        block, n = (pa.compute.struct_field(group.column("seq"), i).to_numpy() for i in (0, 1))
        order = np.lexsort((n, block))
        lengths, need = group.column("length").to_numpy()[order], pa.compute.fill_null(group.column("need"), -1).to_numpy()[order].copy()
        odd = group.column("blank").to_numpy(zero_copy_only=False)[order]
        record, broken = chain(lengths, need) if len(need) > 1 else (np.full(len(need), -1), None)
        if not odd[0]:
            broken, record = 0, np.full(len(need), -1)
        parts = np.bincount(record[record >= 0], minlength=len(need))
        # Pieces that are a whole record are the rule and aren't told; first pieces that are blank are no record.
        alone = (record == np.arange(len(need))) & (parts == 1)
        alone[0] = odd[0]
        some = np.flatnonzero(~alone)
        name = group.column("file")[0].as_py()
        rows = [{"file": name, "seq": {"block": int(block[order[i]]), "n": int(n[order[i]])}, "record": {"block": int(block[order[r]]), "n": int(n[order[r]])} if (r := int(record[i])) >= 0 else None, "broken": None} for i in some]
        if broken is not None:
            rows.append({"file": name, "seq": None, "record": None, "broken": broken})
        settle()
        return pa.Table.from_pylist(rows, schema=into)

    lengths = pieces.select("file", "seq", F.octet_length("value").cast("long").alias("length"), "need", blank.alias("blank"))
    lengths = scratch.write(lengths, "lengths")
    found = scratch.write(lengths.groupBy("file").applyInArrow(link, told), "found")
    broken = found.where("broken is not null").select("file", "broken").orderBy("file").limit(3).collect()
    if strict and broken:
        raise ValueError("broken archives: " + ", ".join(f"{r['file']} at byte {r['broken']}" for r in broken))
    told_apart = found.where("seq is not null").select("file", "seq", F.lit(True).alias("known"), "record")
    first = F.col("need").isNull() & blank
    pieces = pieces.join(if_small(told_apart, told_apart.count(), 200), ["file", "seq"], "left")
    whole = pieces.where(F.col("known").isNull() & ~first).select("file", "seq", "value")
    several = pieces.where(F.col("record").isNotNull()).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("parts"))
    several = several.select("file", F.col("record").alias("seq"), F.array_join("parts.value", MAGIC).alias("value"))
    return parsed(whole.unionByName(several))


def parsed(records: DataFrame) -> DataFrame:
    """The fields of records that are whole, from after MAGIC to the blank lines that end them."""
    head = F.substring_index("value", BREAK, 1)
    of = lambda name: F.regexp_extract(head, f"(?im)^{name}:[ \\t]*(.*?)[ \\t]*\r?$", 1)
    blank = lambda c: F.when(c != "", c)
    inner = lambda c: F.when(c != "", F.regexp_extract(c, "([^:<>]*)>?$", 1))
    skip = F.octet_length(head) + len(BREAK)
    block = F.substring(F.col("value").cast("binary"), skip + 1, F.octet_length("value") - skip - len(BREAK))
    inside = F.substring_index(block.cast("string"), BREAK, 1)
    http = of("content-type").startswith("application/http") & (F.octet_length(inside) < F.octet_length(block))
    payload = F.when(http, F.substring(block, F.octet_length(inside) + len(BREAK) + 1, F.octet_length(block))).otherwise(block)
    return records.select(
        "file", F.col("seq").alias("offset"), blank(of("warc-type")).alias("type"), inner(of("warc-record-id")).alias("record_id"), inner(of("warc-refers-to")).alias("refers_to"),
        blank(of("warc-target-uri")).alias("uri"), F.regexp_replace(of("warc-payload-digest"), "^sha256:", "").alias("digest"), payload.alias("payload"),
    )


def archived_pages(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Writes pages to the shared folder, reads them back, and gives revisits the size and digest that were measured
    on the response which they refer to."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    write_warc(pages, scratch.path("archives"), id_col, payload_col)
    kind = pages.schema[id_col].dataType
    id_of = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    got = read_warc(spark, scratch.path("archives")).select(
        id_of("record_id").alias("id"), F.col("type").alias("record_type"), id_of("refers_to").alias("refers_to"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha")
    )
    got = scratch.write(got, "records")
    scratch.drop("archives")
    again, full = got.where("record_type = 'revisit'"), got.where("record_type = 'response'")
    asked = again.select(F.col("refers_to").alias("id")).distinct()
    targets = full.join(asked, "id", "left_semi").groupBy("id").agg(F.first("bytes").alias("bytes"), F.first("sha").alias("sha"))
    targets = scratch.write(targets.withColumnRenamed("id", "refers_to"), "targets")
    again = again.drop("bytes", "sha").join(if_small(targets, targets.count(), 96), "refers_to", "left")
    out = [F.col("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("record_type"), F.col("refers_to")]
    return full.select(out).unionByName(again.select(out))
