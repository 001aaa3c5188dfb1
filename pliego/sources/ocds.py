"""OCDS release-package sources (SC-1 … SC-3) and projections (PR-1 … PR-8).

* ``read_package_lines``  one package document per line — splittable, the
  layout to land large volumes in.
* ``read_packages``       one (pretty-printed) document per file
  (``multiLine``); a file is one task, so the rows are repartitioned right
  after the releases are exploded.
* ``read_zipped_packages`` zip archives whose first member is a package;
  many archives are opened in parallel, one row per archive.

All readers use the declared schema (``schema.PACKAGE_DDL``).
"""
from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import typed_enquiries
from ..functions.times import date_year
from .schema import PACKAGE_DDL, package_schema, release_type


# Releases that leave a worker in one batch.
RELEASES_AT_ONCE = 200


def read_package_lines(spark: SparkSession, path: str) -> DataFrame:
    """SC-1: JSON lines, one release package per line."""
    return spark.read.schema(package_schema()).json(path)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """SC-2: one whole (possibly pretty-printed) package document per file."""
    return spark.read.schema(package_schema()).option("multiLine", True).json(path)


def read_package_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Packages stored as parquet (``landing.to_parquet``): nested pruning applies."""
    return spark.read.parquet(path)


def _first_member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bodies = []
        for content in pdf["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                bodies.append(z.read(names[0]).decode("utf-8") if names else None)
        yield pd.DataFrame({"path": pdf["path"], "body": bodies})


def read_zipped_packages(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """SC-3: zip archives; the first member of each is parsed as a package."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
           .select("path", "content"))
    bodies = raw.mapInPandas(_first_member, "path string, body string")
    return bodies.select(F.from_json("body", PACKAGE_DDL).alias("p")).select("p.releases")


def _release_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                    found = json.load(member).get("releases") or []
            except (zipfile.BadZipFile, IndexError, AttributeError, ValueError) as e:
                raise ValueError(f"{path}: no archive with a release package: {e!r}") from e
            for k in range(0, len(found), RELEASES_AT_ONCE):
                yield pd.DataFrame({"release": [json.dumps(r) for r in found[k:k + RELEASES_AT_ONCE]]})


def read_zipped_releases(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """SC-3 + PR-1: one row per release of zipped packages.

    Releases leave the worker in batches, so no row holds a whole document; a
    file that is no such archive is an error that names it.
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
           .select("path", "content"))
    texts = raw.mapInPandas(_release_texts, "release string")
    return texts.select(F.from_json("release", release_type()).alias("r")).select("r.*")


def releases(packages: DataFrame, partitions: int | None = None) -> DataFrame:
    """PR-1: one row per release (an empty package gives no row).

    ``partitions`` spreads the releases after the explode — useful when the
    packages were whole documents, each read by a single task.
    """
    out = packages.select(F.inline("releases"))
    return out.repartition(partitions) if partitions else out


def first_release(packages: DataFrame) -> DataFrame:
    """PR-2: the first release of each package (NULL fields for an empty one)."""
    return packages.select(F.get("releases", 0).alias("r")).select("r.*")


def _first(a: Column) -> Column:
    return F.get(a, 0)


def indicator_projection(packages: DataFrame) -> DataFrame:
    """PR-2, PR-4, PR-5, PR-8: the indicator pipeline's 38 named columns.

    One row per package line, fields of its first release (``get`` — never
    ``[0]``, which raises on an empty array under ANSI).  ``category`` is the
    procurement category of *all* releases of the package.
    """
    rel = F.col("releases")
    r = _first(rel)
    t = r["tender"]
    award = _first(r["awards"])
    contract = _first(r["contracts"])
    auction = _first(r["auctions"])
    enq = typed_enquiries(t["enquiries"])
    return packages.select(
        r["ocid"].alias("ocid"), r["date"].alias("date"), r["tag"].alias("tag"),
        r["bids"].alias("mc_bids"),
        r["planning"]["budget"]["amount"]["amount"].alias("PreRefe"),
        t["procuringEntity"]["id"].alias("in_ent"), t["id"].alias("id"),
        t["description"].alias("description"), t["value"]["amount"].alias("Tvalue"),
        t["procuringEntity"]["name"].alias("enti_name"),
        t["procurementMethodDetails"].alias("PMethoDetails"),
        t["tenderPeriod"]["startDate"].alias("TTPSDate"),
        t["tenderPeriod"]["endDate"].alias("TTPEDate"),
        t["enquiryPeriod"]["startDate"].alias("TEPSDate"),
        t["enquiryPeriod"]["endDate"].alias("TEPEDate"),
        t["awardPeriod"]["startDate"].alias("TAPSDate"),
        t["awardPeriod"]["endDate"].alias("TAPEDate"),
        t["numberOfTenderers"].alias("n_of_Tend"),
        rel["tender"]["mainProcurementCategory"].alias("category"),
        enq.alias("enquiries"),
        enq["description"].alias("enq_desc"), enq["date"].alias("enq_fechas"),
        enq["dateAnswered"].alias("enq_ans_fechas"), enq["answer"].alias("enq_ans"),
        award["date"].alias("awardsDate"), award["value"]["amount"].alias("awardsvalue"),
        award["contractPeriod"]["startDate"].alias("ACPSDate"),
        award["contractPeriod"]["endDate"].alias("ACPEDate"),
        _first(award["suppliers"])["id"].alias("award_id"),
        contract["period"]["startDate"].alias("CCPSDate"),
        contract["period"]["endDate"].alias("CCPEDate"),
        contract["value"]["amount"].alias("ContractValue"),
        contract["dateSigned"].alias("dateSigned"),
        auction["period"]["startDate"].alias("bid_st_Date"),
        auction["period"]["endDate"].alias("bid_en_Date"),
        _first(auction["stages"])["bids"].alias("bids"),
        rel["parties"].alias("parties"),
        date_year(t["tenderPeriod"]["startDate"]).alias("year"),
    )


INDICATOR_SQL = """
SELECT get(releases, 0).ocid AS ocid,
       get(releases, 0).tender.procurementMethodDetails AS PMethoDetails,
       get(releases, 0).tender.procuringEntity.id AS in_ent,
       get(releases, 0).tender.tenderPeriod.startDate AS TTPSDate,
       get(get(releases, 0).awards, 0).value.amount AS awardsvalue,
       get(get(releases, 0).contracts, 0).value.amount AS ContractValue,
       CAST(array_size(get(get(get(releases, 0).auctions, 0).stages, 0).bids) AS BIGINT) AS NF018,
       CAST(YEAR(TRY_CAST(get(releases, 0).tender.tenderPeriod.startDate AS DATE)) AS BIGINT) AS year
FROM {view}"""


def sql_projection(spark: SparkSession, packages: DataFrame, view: str = "ocds_packages") -> DataFrame:
    """SC-5: register the scan as a (session-scoped) view and project in SQL."""
    packages.createOrReplaceTempView(view)
    return spark.sql(INDICATOR_SQL.format(view=view))
