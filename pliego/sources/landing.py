"""Land release packages derived from the test tables (inputs for SC-1 … SC-3).

A Spark job turns the fixture views into OCDS releases and writes them as
JSON lines; whole-document files, zip archives and parquet are derived from
that landing, so every reader has input that grows with the tables.  Output
goes under the cluster's shared checkpoint folder.

Text is landed with gzip: a release repeats the names of its fields, so that
takes a fraction of the bytes.  Such a file is read by one task, so its lines
are bounded.  What is shuffled are the columns of the tables; the texts made of
them, several times as long, are built behind the shuffle.

A release holds all bids and questions of its tender, however many: the
document format has one release per tender, and splitting it would change
what every per-release measure counts.
"""
from __future__ import annotations

import io
import math
import shutil
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import iso_with_offset
from ..plans.views import bids_view, enquiry_view, tenders_of
from ..session import shared_dir
from .files import filesystem, qualified
from .tables import table

RELEASES_PER_FILE = 5000  # releases per whole-document package file
LINES_PER_FILE = 50_000   # releases per file of the JSON-lines landing
BIDS_PER_TASK = 200_000   # about as many bids does a task make releases of
# Text is written with gzip at its fastest: by default it takes several times as long for three quarters of the bytes.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
TASK_BYTES = "16m"        # bytes of landed lines that one task stores as parquet
OFFSET = "-05:00"         # UTC offset written into every landed timestamp
FIRST_METHOD = "first_method"  # partition column of the parquet landing


def _iso(c: str) -> Column:
    return iso_with_offset(F.col(c), OFFSET)


def _period(a: str, b: str) -> Column:
    return F.struct(_iso(a).alias("startDate"), _iso(b).alias("endDate"))


def _value(c: Column) -> Column:
    return F.struct(c.alias("amount"), F.lit("USD").alias("currency"))


def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per release: ``ocid`` and the release as JSON text."""
    b = bids_view(spark, sf_dir).select("tender_key", "l_linenumber", "l_partkey", "bid_ts", "tenderer_id", "amount")
    tasks = math.ceil(b.count() / BIDS_PER_TASK)
    # dealt out by key as they are: a list of each map task's own bids would send their texts
    b = b.repartition(tasks, "tender_key") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else b.repartition("tender_key")
    e = enquiry_view(spark, sf_dir)
    bid_item = F.struct(
        F.concat_ws("-", F.col("tender_key"), F.col("l_linenumber"), F.col("l_partkey")).alias("id"),
        _iso("bid_ts").alias("date"),
        F.array(F.struct(F.col("tenderer_id").cast("string").alias("id"),
                         F.concat(F.lit("Proveedor "), F.col("tenderer_id")).alias("name"))).alias("tenderers"),
        _value(F.col("amount")).alias("value"))
    # Questions are written as JSON text so that, by rule, some unanswered
    # ones *omit* the ``answer`` key instead of writing ``null`` — the two
    # differ for the scoring flow's unanswered count (explicit nulls only).
    enq_json = F.to_json(F.struct(
        F.col("enq_no").cast("string").alias("id"), "description", "answer",
        _iso("asked_ts").alias("date"), _iso("answered_ts").alias("dateAnswered"),
        F.struct(F.col("author_id").alias("id"),
                 F.concat(F.lit("Autor "), F.col("author_id")).alias("name")).alias("author")),
        {"ignoreNullFields": "false"})
    omit_answer = F.col("answer").isNull() & (F.col("enq_no") % 4 == 1)
    enq_item = F.when(omit_answer, F.replace(enq_json, F.lit('"answer":null,'), F.lit(""))) \
                .otherwise(enq_json)
    bids = b.groupBy("tender_key").agg(F.collect_list(bid_item).alias("bid_items"))
    questions = (e.groupBy("tender_key").agg(F.collect_list(enq_item).alias("enq_items"))
                 .withColumn("enq_items", F.concat(F.lit("["), F.array_join("enq_items", ","), F.lit("]"))))
    orders = table(spark, sf_dir, "orders").withColumn("_key", F.col("o_orderkey"))
    for items in (bids, questions):
        orders = orders.join(items.withColumnRenamed("tender_key", "_key"), "_key", "left")
    rows = tenders_of(orders, "bid_items", "enq_items")
    release = F.struct(
        F.col("ocid"), _iso("start_ts").alias("date"), F.array(F.lit("tender")).alias("tag"),
        F.struct(F.struct(_value(F.col("contract_value")).alias("amount")).alias("budget")).alias("planning"),
        F.struct(
            F.col("tender_key").cast("string").alias("id"),
            F.lit(None).cast("string").alias("description"),
            F.col("method").alias("procurementMethodDetails"),
            F.when(F.col("tender_key") % 2 == 0, F.lit("goods")).otherwise(F.lit("services"))
             .alias("mainProcurementCategory"),
            F.col("n_tenderers").alias("numberOfTenderers"),
            F.struct(F.col("in_ent").alias("id"),
                     F.concat(F.lit("Entidad "), F.col("in_ent")).alias("name")).alias("procuringEntity"),
            _value(F.col("contract_value")).alias("value"),
            _period("start_ts", "close_ts").alias("tenderPeriod"),
            _period("enq_start", "enq_end").alias("enquiryPeriod"),
            _period("award_start", "award_end").alias("awardPeriod"),
            F.parse_json(F.col("enq_items")).alias("enquiries"),
        ).alias("tender"),
        F.array(F.struct(
            _iso("award_end").alias("date"), _value(F.col("award_value")).alias("value"),
            _period("award_end", "close_ts").alias("contractPeriod"),
            F.array(F.struct(F.concat(F.lit("P"), F.col("buyer_key")).alias("id"),
                             F.concat(F.lit("Proveedor "), F.col("buyer_key")).alias("name")))
             .alias("suppliers"))).alias("awards"),
        F.array(F.struct(
            _period("signed_ts", "close_ts").alias("period"),
            _value(F.col("contract_value")).alias("value"),
            _iso("signed_ts").alias("dateSigned"))).alias("contracts"),
        F.array(F.struct(
            _period("auction_start", "close_ts").alias("period"),
            F.array(F.struct(F.col("bid_items").alias("bids"))).alias("stages"))).alias("auctions"),
    )
    return rows.select("ocid", F.to_json(release, {"ignoreNullFields": "false"}).alias("release"))


def _frame_documents(releases_per_file: int):
    """Releases → pretty-printed ``{"releases": [...]}`` documents of ``releases_per_file`` rows each, the last of a partition of fewer (or none)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, 0
        for pdf in batches:
            out = []
            for rel in pdf["release"]:
                if held is not None:
                    out.append(held + ("" if at % releases_per_file else "\n]}"))
                held = (", " if at % releases_per_file else '{"releases": [\n  ') + rel
                at += 1
            yield pd.DataFrame({"value": out}, dtype=object)
        yield pd.DataFrame({"value": [('{"releases": [' if held is None else held) + "\n]}"]})
    return run


def _zip_files(out_dir: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = filesystem(out_dir)
        store.create_dir(base, recursive=True)
        for pdf in batches:
            paths = []
            for path in pdf["path"]:
                source, at = filesystem(path)
                name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz")
                buf = io.BytesIO()
                with (zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, source.open_input_stream(at) as document,
                      z.open("releases.json", "w", force_zip64=True) as member):
                    shutil.copyfileobj(document, member, 1 << 20)  # the stream undoes gzip
                target = f"{base}/{name}.zip"
                with store.open_output_stream(target) as fh:  # same name on retry
                    fh.write(buf.getbuffer())
                paths.append(target)
            yield pd.DataFrame({"zip_path": paths})
    return run


_PREFIX, _SUFFIX = '{"releases": [', "]}"


def land(spark: SparkSession, sf_dir: str, layout: str = "lines", out_dir: str | None = None,
         releases_per_file: int = RELEASES_PER_FILE) -> str:
    """Write the releases of ``sf_dir`` in ``layout``; return the folder.

    ``lines``: one package (one release) per line.  ``package``: one whole
    document per file.  ``zip``: each package file zipped as one archive.
    The last two re-frame the JSON-lines landing instead of rebuilding it.
    """
    out = out_dir or shared_dir(spark, "landing", layout)
    if layout == "lines":
        rel = release_rows(spark, sf_dir)
        rel.select(F.concat(F.lit(_PREFIX), F.col("release"), F.lit(_SUFFIX)).alias("value")) \
           .write.mode("overwrite").options(**GZIP, maxRecordsPerFile=LINES_PER_FILE).text(out)
    elif layout == "package":
        documents_from_lines(spark, land(spark, sf_dir, "lines", out + "_lines"), out, releases_per_file)
    elif layout == "zip":
        zips_from_documents(spark, land(spark, sf_dir, "package", out + "_documents", releases_per_file), out)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return out


def documents_from_lines(spark: SparkSession, lines_dir: str, out_dir: str,
                         releases_per_file: int = RELEASES_PER_FILE) -> str:
    """Re-frame JSON-lines packages as whole documents of at most
    ``releases_per_file`` releases each (one ``{"releases": [...]}`` per file).

    A task frames the releases that it reads, so none is shuffled: a document is
    as many rows as the writer puts into one file.
    """
    lines = spark.read.text(lines_dir)
    rel = lines.select(F.expr(f"substring(value, {len(_PREFIX) + 1}, "
                              f"length(value) - {len(_PREFIX) + len(_SUFFIX)})").alias("release"))
    if lines.isEmpty():
        rel = rel.repartition(1)  # a task even if there is no file
    (rel.mapInPandas(_frame_documents(releases_per_file), "value string")
        .write.mode("overwrite").options(**GZIP, maxRecordsPerFile=releases_per_file).text(out_dir))
    return out_dir


def zips_from_documents(spark: SparkSession, doc_dir: str, out_dir: str) -> str:
    """Zip every package document into its own archive; tasks get the paths and read the documents as streams."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(doc_dir).select("path")
    raw.mapInPandas(_zip_files(qualified(spark, out_dir)), "zip_path string").write.format("noop") \
       .mode("overwrite").save()
    return out_dir


def to_parquet(spark: SparkSession, lines_dir: str, out_dir: str | None = None) -> str:
    """Parse JSON-lines packages once and store them as parquet.

    Same ``releases`` column and schema, but later reads skip JSON parsing and
    get nested-column pruning (only the fields a query touches are read).  The
    files are partitioned by the first release's procurement method.  Spark sorts
    each task's rows by it, so a session of its own, with smaller tasks, keeps that in memory.
    """
    from .ocds import read_package_lines
    out = out_dir or shared_dir(spark, "landing", "parquet")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)
    pk = read_package_lines(own, lines_dir)
    # the first release's method as a partition column: the indicator flow's
    # method filter then prunes whole directories instead of parsing rows
    first_method = F.get(F.col("releases"), 0)["tender"]["procurementMethodDetails"]
    pk.select("releases", first_method.alias(FIRST_METHOD)).write.mode("overwrite") \
      .partitionBy(FIRST_METHOD).parquet(out, compression="zstd")
    return out


_LANDED: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str, layout: str = "lines") -> str:
    """``land`` once per (application, data dir, layout), then reuse; call ``forget_landed`` if the data change.

    The JSON-lines landing is built once; ``package`` / ``zip`` re-frame it and
    ``parquet`` is it converted by ``to_parquet``.
    """
    k = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), layout)
    if k not in _LANDED:
        if layout == "lines":
            _LANDED[k] = land(spark, sf_dir, "lines")
        elif layout == "parquet":
            _LANDED[k] = to_parquet(spark, landed(spark, sf_dir, "lines"))
        elif layout == "package":
            _LANDED[k] = documents_from_lines(spark, landed(spark, sf_dir, "lines"),
                                              shared_dir(spark, "landing", "package"))
        elif layout == "zip":
            _LANDED[k] = zips_from_documents(spark, landed(spark, sf_dir, "package"),
                                             shared_dir(spark, "landing", "zip"))
        else:
            raise ValueError(f"unknown layout {layout!r}")
    return _LANDED[k]


def forget_landed() -> None:
    """The next ``landed`` call writes anew (the tables of a folder have changed)."""
    _LANDED.clear()
