"""WARC archives of pages, and their capture index by an external merge.

Writing: one record per page through Spark's text writer, whose line separator
is the end of a record, so commits and retries are Spark's.  Of pages with equal
payloads the one with the smallest id is stored and the others are revisit
records that refer to it.  A payload that holds a record's first line is cut
there into a response and continuation records, so that record bounds are exact.

Reading: the text reader splits archives at record bounds; all parsing is by
built-in functions and goes by the records' lengths.

Index: every archive partition gives a run of captures sorted by URL key and
time, written to the shared folder.  Runs are dealt out by key ranges; a range's
slices of all runs are merged by a loser tree.  Ranges follow each other, so the
index is in global order and a URL's captures stand together as its history.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, new_folder, written

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Time of the first capture where pages carry none (seconds; 2024-01-01).
EPOCH = 1704067200


def record_id(*cols: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]), 256)
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))],
                    F.substring(h, 21, 12))


def field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def capture_time() -> Column:
    seconds = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(315_360_000)))
    return F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def revisits(pages: DataFrame) -> DataFrame:
    """(in_page, in_digest, refers_to) of the pages whose payload another page stores."""
    rows = written(pages.select("page_id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("n"))
                   .filter(F.col("n") >= REVISIT_BYTES), "digests")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1")
    shared = written(first, "shared-payloads")
    found = join_unique(rows.select("page_id", "digest"), shared, "digest", "rows", rows.count())
    return written(found.filter("refers_to IS NOT NULL AND NOT (page_id <=> refers_to)")
                   .select(F.col("page_id").alias("in_page"), F.col("digest").alias("in_digest"), "refers_to").distinct(), "revisits")


def records(pages: DataFrame) -> DataFrame:
    """(value): the WARC records of pages (page_id, url, html), without the separator behind each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\\r\\n]", "%0A").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    refer = revisits(rows)
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    if refer.isEmpty():
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    else:
        rows = rows.join(refer, F.col("page_id").eqNullSafe(F.col("in_page")) & (F.col("digest") == F.col("in_digest")), "left")
    again = F.col("refers_to").isNotNull()
    first_line = F.contains(F.col("payload"), F.lit(VERSION.strip()))
    parts = (F.when(again, F.array(F.lit("")))
             .when(first_line, F.split("payload", "(?<=WARC/1)(?=\\.1)", -1)).otherwise(F.array("payload")))
    rows = rows.select("page_id", "url", "digest", "refers_to", F.octet_length("payload").alias("n"), capture_time().alias("date"),
                       F.size(parts).alias("segments"), F.posexplode(parts).alias("segment", "part"))
    own = record_id(F.col("page_id"), F.col("digest"))
    start = F.col("segment") == 0
    block = F.when(start, F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(END), F.col("part"))).otherwise(F.col("part"))
    several = F.col("segments") > 1
    kind = F.when(~start, F.lit("continuation")).when(again, F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat(
        F.lit(VERSION), field("WARC-Type", kind),
        field("WARC-Record-ID", F.concat(F.lit("<"), F.when(start, own).otherwise(record_id(F.col("page_id"), F.col("digest"), F.col("segment"))), F.lit(">"))),
        field("WARC-Date", F.col("date")), field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        field("WARC-Refers-To", F.when(again, F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("digest")), F.lit(">")))),
        field("WARC-Segment-Number", F.when(several, F.col("segment") + 1)),
        field("WARC-Segment-Origin-ID", F.when(~start, F.concat(F.lit("<"), own, F.lit(">")))),
        field("Page-ID", F.col("page_id")), field("Refers-To-Page", F.col("refers_to")),
        field("Content-Type", F.when(start, F.lit("application/http; msgtype=response")).otherwise(F.lit("application/octet-stream"))),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, html), one or more per task, gzipped.

    Null html is an empty payload; null ids and URLs leave their header out;
    repeated rows give repeated records.
    """
    records(pages).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, page_id, url, date, digest, refers_to, payload_bytes, payload) of the archives' responses and revisits.

    payload_bytes is the full payload's; payload is null for revisits.  A
    response whose payload has not the digest of its header is an error.
    """
    rows = spark.read.schema("value string").option("lineSep", END + VERSION).text(path).filter("value <> ''")
    head = F.substring_index("value", END, 1)

    def get(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", f"(?m)^{name}: *(.*?)\\r?$", 1), F.lit(""))
    data = F.col("value").cast("binary")
    rows = rows.withColumn("head", head).select(
        "head", get("WARC-Type").alias("record_type"), F.regexp_replace(get("WARC-Record-ID"), "[<>]", "").alias("record_id"),
        F.regexp_replace(get("WARC-Segment-Origin-ID"), "[<>]", "").alias("origin"), get("WARC-Segment-Number").cast("int").alias("segment"),
        get("Page-ID").cast("long").alias("page_id"), get("WARC-Target-URI").alias("url"), get("WARC-Date").alias("date"),
        F.regexp_replace(get("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), get("Refers-To-Page").cast("long").alias("refers_to"),
        F.substring(data, F.octet_length("head") + len(END) + 1, get("Content-Length").cast("int")).cast("string").alias("block"))
    http = F.substring_index("block", END, 1)
    first = (rows.filter(F.col("record_type").isin("response", "revisit")).withColumn("http", http)
             .withColumn("payload_bytes", F.regexp_extract("http", "(?m)^Content-Length: *(\\d+)", 1).cast("long"))
             .withColumn("payload", F.when(F.col("record_type") == "response",
                                           F.expr(f"substring(block, length(http) + {len(END) + 1})"))))
    rest = (rows.filter(F.col("record_type") == "continuation").groupBy("origin")
            .agg(F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("more")))
    more = F.array_join(F.transform("more", lambda x: x["block"]), "")
    joined = (first.filter("segment IS NOT NULL").drop("origin").join(rest, F.col("record_id") == F.col("origin"), "left")
              .withColumn("payload", F.concat("payload", F.coalesce(more, F.lit("")))))
    cols = ["record_id", "record_type", "page_id", "url", "date", "digest", "refers_to", "payload_bytes", "payload"]
    whole = first.filter("segment IS NULL").select(*cols).unionByName(joined.select(*cols))
    same = F.sha2(F.col("payload").cast("binary"), 256) == F.col("digest")
    return whole.withColumn("payload", F.when(F.col("payload").isNull() | same, F.col("payload"))
                            .otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("record_id", F.lit("?"))))))


# ------------------------------------------------------------------ index

def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, port if it isn't the scheme's, path and query; no scheme, user or fragment."""
    part = [F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^/@?#]*@)?([^/:?#]*)(?::(\d*))?([^?#]*)(\?[^#]*)?", k) for k in range(1, 6)]
    scheme, host, port, path, query = part
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(host), r"^www\d*\.", ""), "\\.")), ",")
    usual = (port == "") | ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443"))
    return F.concat(labels, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.lit(")"),
                    F.when(path == "", F.lit("/")).otherwise(path), query)


class LoserTree:
    """Merge of sorted lists: each inner node keeps the loser of its match, the winner moves on."""

    def __init__(self, lists: list[list]):
        self.lists, self.at = lists, [0] * len(lists)
        k = max(1, len(lists))
        self.leaves = 1 << (k - 1).bit_length()
        self.node = [-1] * self.leaves
        self.winner = self.play(1)

    def head(self, run: int):
        return self.lists[run][self.at[run]]

    def before(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; finished runs come last, equal heads in order of runs."""
        if a < 0 or a >= len(self.lists) or self.at[a] >= len(self.lists[a]):
            return False
        if b < 0 or b >= len(self.lists) or self.at[b] >= len(self.lists[b]):
            return True
        x, y = self.head(a), self.head(b)
        return x < y or x == y and a < b

    def play(self, n: int) -> int:
        """First round below node n: returns its winner."""
        if n >= self.leaves:
            return n - self.leaves
        a, b = self.play(2 * n), self.play(2 * n + 1)
        won, lost = (b, a) if self.before(b, a) else (a, b)
        self.node[n] = lost
        return won

    def __iter__(self):
        while self.winner < len(self.lists) and self.at[self.winner] < len(self.lists[self.winner]):
            run = self.winner
            yield self.head(run)
            self.at[run] += 1
            n = (run + self.leaves) >> 1
            while n:
                if self.before(self.node[n], run):
                    self.node[n], run = run, self.node[n]
                n >>= 1
            self.winner = run


INDEX = "url_key string, date string, page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long"
NAMES = [f.split()[0] for f in INDEX.split(", ")]


def sorted_runs(captures: DataFrame) -> DataFrame:
    """The captures as runs: each input partition sorted and written; ``run`` is its number."""
    rows = captures.select(F.coalesce(url_key(F.col("url")), F.lit("")).alias("url_key"), "date", "page_id", "record_id", "record_type",
                           F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
                           F.coalesce(F.sha2(F.col("payload").cast("binary"), 256), "digest").alias("payload_digest"), "refers_to")
    return written(rows.sortWithinPartitions("url_key", "date", "page_id", "record_id").withColumn("run", F.spark_partition_id()), "runs")


def merged_index(runs: DataFrame) -> DataFrame:
    """The index in global order: key ranges, each merged from its slices of the runs."""
    ranges = runs.repartitionByRange("url_key", "date", "page_id", "record_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # a range, so a bounded share of the index
        if not got:
            return
        table = pa.Table.from_batches(got)
        slices: dict[int, list[tuple]] = {}
        keys = zip(*[[("" if x is None else x) if k != 2 else (x is not None, x or 0) for x in table.column(k).to_pylist()] for k in range(4)])
        for n, (r, key) in enumerate(zip(table.column(len(NAMES)).to_pylist(), keys)):
            slices.setdefault(r, []).append((*key, n))
        for s in slices.values():
            s.sort()  # in order already, unless blocks of one run came in another order
        order = [x[-1] for x in LoserTree([slices[r] for r in sorted(slices)])]
        yield from table.take(pa.array(order)).drop_columns(["run"]).combine_chunks().to_batches(max_chunksize=10_000)
    return ranges.select(*NAMES, "run").mapInArrow(run, INDEX)


def capture_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives ``pages``, reads the archives back and returns their merged index."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "archives")
    write_archives(pages, path)
    return merged_index(sorted_runs(read_archives(spark, path)))
