"""Explicit read schema for OCDS release packages.

Declaring the schema removes the inference pass and is the only column
pruning a JSON scan gets (Spark does not prune nested JSON fields).  Fields
absent from a document read as NULL.  ``tender.enquiries`` is VARIANT so an
explicit ``"answer": null`` can be told from a missing ``answer`` key.
"""
from __future__ import annotations

from pyspark.sql.types import DataType, StructType

_PERIOD = "STRUCT<startDate: STRING, endDate: STRING>"
_VALUE = "STRUCT<amount: DOUBLE, currency: STRING>"
_PARTY = "STRUCT<id: STRING, name: STRING>"

BID_DDL = f"STRUCT<id: STRING, date: STRING, tenderers: ARRAY<{_PARTY}>, value: {_VALUE}>"

RELEASE_DDL = f"""STRUCT<
  ocid: STRING, date: STRING, tag: ARRAY<STRING>, bids: VARIANT, parties: VARIANT,
  planning: STRUCT<budget: STRUCT<amount: {_VALUE}>>,
  tender: STRUCT<
    id: STRING, description: STRING, procurementMethodDetails: STRING,
    mainProcurementCategory: STRING, numberOfTenderers: BIGINT,
    procuringEntity: {_PARTY},
    value: {_VALUE},
    tenderPeriod: {_PERIOD},
    enquiryPeriod: {_PERIOD},
    awardPeriod: {_PERIOD},
    enquiries: VARIANT>,
  awards: ARRAY<STRUCT<date: STRING, value: {_VALUE}, contractPeriod: {_PERIOD},
    suppliers: ARRAY<{_PARTY}>>>,
  contracts: ARRAY<STRUCT<period: {_PERIOD}, value: {_VALUE}, dateSigned: STRING>>,
  auctions: ARRAY<STRUCT<period: {_PERIOD}, stages: ARRAY<STRUCT<bids: ARRAY<{BID_DDL}>>>>>
>"""

PACKAGE_DDL = f"releases ARRAY<{RELEASE_DDL}>"

ENQUIRY_DDL = (
    "ARRAY<STRUCT<id: STRING, description: STRING, answer: STRING, date: STRING, "
    f"dateAnswered: STRING, author: {_PARTY}>>"
)


def package_schema() -> StructType:
    return StructType.fromDDL(PACKAGE_DDL)


def release_type() -> DataType:
    return package_schema()["releases"].dataType.elementType
