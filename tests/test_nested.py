"""Golden rows for the nested (higher-order function) measures and the sources."""
from pyspark.sql import functions as F

from pliego.functions import nested as N
from pliego.sources.ocds import (first_release, indicator_projection, read_package_lines, read_packages,
                                 releases)


def rel(ocid="ocds-5wno2w-SIE-1-2022-1", enquiries=None, bids=None, in_ent="E1", close="2022-02-01T00:00:00-05:00",
        end="2022-01-10T00:00:00-05:00"):
    t = {"procurementMethodDetails": "M", "procuringEntity": {"id": in_ent},
         "enquiryPeriod": {"startDate": "2022-01-01T00:00:00-05:00", "endDate": end}}
    if enquiries is not None:
        t["enquiries"] = enquiries
    r = {"ocid": ocid, "tender": t, "auctions": [{"period": {"endDate": close}, "stages": [{"bids": bids}]}]}
    return r


def q(desc, answer="MISSING", date="2022-01-05T00:00:00-05:00", answered=None, author="S1"):
    e = {"description": desc, "date": date, "author": {"id": author, "name": "n"}}
    if answer != "MISSING":
        e["answer"] = answer
    if answered:
        e["dateAnswered"] = answered
    return e


def measures(spark, tmp_json, releases_list, **kw):
    path = tmp_json([{"releases": [r]} for r in releases_list])
    r = releases(read_package_lines(spark, path))
    t = F.col("tender")
    enq = N.typed_enquiries(t["enquiries"])
    bids = F.get(F.get(F.col("auctions"), 0)["stages"], 0)["bids"]
    return r.select(
        N.unanswered_wide(t["enquiries"]).alias("wide"),
        N.late_questions(enq, N.instant(t["enquiryPeriod"]["endDate"]), **kw).alias("late"),
        N.unanswered_narrow(enq, t["procuringEntity"]["id"]).alias("narrow"),
        N.mean_response_days(enq).alias("mean"),
        N.late_bids(bids, F.get(F.col("auctions"), 0)["period"]["endDate"]).alias("late_bids"),
        N.array_len(bids).alias("n_bids"),
    ).collect()


def test_pretty_printed_package_reads_whole(spark, tmp_json):
    path = tmp_json({"releases": [rel(), rel(ocid="b")]}, pretty=True)
    df = read_packages(spark, path)
    assert df.columns == ["releases"] and df.count() == 1
    assert releases(df).count() == 2


def test_empty_releases(spark, tmp_json):
    path = tmp_json([{"releases": []}])
    pk = read_package_lines(spark, path)
    assert releases(pk).count() == 0
    r = first_release(pk).collect()
    assert len(r) == 1 and r[0].ocid is None
    assert indicator_projection(pk).count() == 1


def test_unanswered_wide_explicit_null_vs_missing(spark, tmp_json):
    r = measures(spark, tmp_json, [
        rel(enquiries=[q("a", None), q("b"), q("c", "x")]),
        rel(enquiries=[q("a"), q("CONVALIDAR b"), q("c")]),
        rel(enquiries=None), rel(enquiries=[]), rel(enquiries=[q(None, None), q("x", None)])])
    assert [x.wide for x in r] == [1, 3, None, None, None]


def test_late_questions(spark, tmp_json):
    late = "2022-01-20T00:00:00-05:00"
    r = measures(spark, tmp_json, [rel(enquiries=[
        q("plain", date=late), q("CONVALIDAR once", date=late), q("CONVALIDA convalidar", date=late),
        q("on time"), q("no date", date=None)])])
    assert r[0].late == 3
    assert measures(spark, tmp_json, [rel(enquiries=[q("plain", date=late)])], compat_zero=True)[0].late == 0
    assert measures(spark, tmp_json, [rel(enquiries=None)])[0].late == 0


def test_unanswered_narrow(spark, tmp_json):
    r = measures(spark, tmp_json, [
        rel(enquiries=[q("a", None, author="E1"), q("b", None, author="E1")]),
        rel(enquiries=[q("a", None), q("Convalidación x", None), q(None, None), q("d", "ok")]),
        rel(enquiries=[]), rel(enquiries=[q("a", None)], in_ent=None),
        rel(enquiries=[{"description": "a", "answer": None, "author": {"name": "n"}}])])
    assert [x.narrow for x in r] == [0, 1, None, None, None]


def test_mean_response_days(spark, tmp_json):
    d0 = "2022-01-01T00:00:00-05:00"
    r = measures(spark, tmp_json, [
        rel(enquiries=[q("a", "x", d0, "2022-01-02T00:00:00-05:00"), q("b", "y", d0, "2022-01-03T00:00:00-05:00")]),
        rel(enquiries=[q("a", "x", d0, "2022-01-02T00:00:00-05:00"), q("b", None, d0)]),
        rel(enquiries=[])])
    assert [x.mean for x in r] == [1.5, None, None]


def test_late_bids(spark, tmp_json):
    ok = {"id": "1", "date": "2022-03-01T00:00:00-05:00", "tenderers": [{"id": "t", "name": "n"}],
          "value": {"amount": 1.0}}
    early = dict(ok, date="2022-01-01T00:00:00-05:00")
    r = measures(spark, tmp_json, [
        rel(bids=[ok, early]), rel(bids=[ok], close=None), rel(bids=[dict(ok, tenderers=None)]),
        rel(bids=[dict(ok, tenderers=[])]), rel(bids=[]), rel(bids=None)])
    assert [x.late_bids for x in r] == [1, 0, None, None, None, None]
    assert [x.n_bids for x in r] == [2, 1, 1, 1, 0, None]


def test_counts(spark):
    df = spark.createDataFrame([(["a", "", None, "b"],), (None,), ([],)], "a array<string>")
    assert [r[0] for r in df.select(N.count_truthy("a")).collect()] == [2, None, 0]
    assert [r[0] for r in df.select(N.array_len("a")).collect()] == [4, None, 0]


def test_late_bids_flat_equals_nested(spark, tmp_json):
    """A bid whose value entry has no amount counts; one without the entry makes the measure unknown: in both forms."""
    from pliego.operators.bids import bid_flat, bid_stats
    from pyspark.sql import functions as F
    day = "2022-03-01T00:00:00-05:00"
    bid = {"id": "1", "date": day, "tenderers": [{"id": "t", "name": "n"}], "value": {"amount": 1.0}}
    releases = [rel(bids=[bid, dict(bid, value={"amount": None})]), rel(bids=[bid, dict(bid, value=None)]),
                rel(bids=[dict(bid, tenderers=[])]), rel(bids=[dict(bid, tenderers=[{"id": None, "name": "n"}])])]
    nested = [(r.n_bids, r.late_bids) for r in measures(spark, tmp_json, releases)]
    item = "array<struct<id:string,date:string,tenderers:array<struct<id:string,name:string>>,value:struct<amount:double>>>"
    rows = [(k, r["auctions"][0]["stages"][0]["bids"], r["auctions"][0]["period"]["endDate"]) for k, r in enumerate(releases)]
    df = spark.createDataFrame(rows, f"tender_key long, bids {item}, close string")
    bids = bid_flat(df.select("tender_key", F.explode("bids").alias("b")).select("tender_key", "b.*"))
    stats = bid_stats(bids.withColumn("bid_ts", F.col("date").cast("timestamp")),
                      df.select("tender_key", F.col("close").cast("timestamp").alias("close_ts")))
    assert [(r.NF018, r.Nf030) for r in stats.orderBy("tender_key").collect()] == nested
