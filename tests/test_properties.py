"""Property tests: the Spark rules against plain-Python statements of the same
semantics (timedelta days, regex search, splitlines, tag removal), many
generated inputs per Spark job."""
import re
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st

from pliego.functions import text as T
from pliego.functions import times as D

BASE = datetime(2022, 6, 1, tzinfo=timezone.utc)
offsets = st.sampled_from([-5, -3, 0, 2, 5])
stamps = st.tuples(st.integers(-10**8, 10**8), offsets).map(
    lambda t: (BASE + timedelta(seconds=t[0])).astimezone(timezone(timedelta(hours=t[1]))))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(stamps, stamps), min_size=20, max_size=80))
def test_floor_days_is_timedelta_days(spark, pairs):
    rows = [(a.isoformat(), b.isoformat()) for a, b in pairs]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(D.floor_days(D.instant("a"), D.instant("b"))).collect()]
    assert got == [(a - b).days for a, b in pairs]


CODE = re.compile(r"ocds-5wno2w-(.*\w*.)-|")
pieces = st.sampled_from(["ocds-5wno2w-", "SIE", "-", "2022", "x", "B-", "--", "a_b", "9"])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(pieces, max_size=8).map("".join), min_size=20, max_size=80))
def test_process_code_matches_search_semantics(spark, ids):
    def want(s):
        m = CODE.search(s)
        return m.group(1) if m and m.group(1) else None
    df = spark.createDataFrame([(s,) for s in ids], "s string")
    assert [r[0] for r in df.select(T.process_code("s")).collect()] == [want(s) for s in ids]


texts = st.text(alphabet="ab <>/\n\r", max_size=30)


@settings(max_examples=3, deadline=None)
@given(st.lists(texts, min_size=20, max_size=80))
def test_lines_and_tags(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select(T.text_lines("s"), T.strip_tags("s")).collect()
    assert [r[0] for r in rows] == [v.splitlines() for v in values]
    assert [r[1] for r in rows] == [re.sub(r"<[^>]+>", "", v) for v in values]


# --- nested measures on generated release documents ---------------------------

import json  # noqa: E402
import tempfile  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from pliego.functions import nested as N  # noqa: E402
from pliego.sources.ocds import read_package_lines, releases  # noqa: E402

MISSING = object()
question = st.fixed_dictionaries({}, optional={
    "description": st.sampled_from([None, "pregunta", "Convalidación de ofertas", "convalidar", "x"]),
    "answer": st.sampled_from([None, "respuesta"]),
})


def unanswered_wide_spec(qs):
    """Pre_No_Respu of the scoring flow, stated over plain dicts."""
    if qs is None or len(qs) == 0:
        return None
    if not any("answer" in q for q in qs):
        return len(qs) if any("description" in q for q in qs) else None
    n = 0
    for q in qs:
        d = q.get("description")
        if d is None:
            return None
        if re.search(T.RE_WIDE, d):
            continue
        if "answer" in q and q["answer"] is None:
            n += 1
    return n


def _read(spark, docs):
    d = tempfile.mkdtemp(prefix="pliego-prop-")
    with open(f"{d}/p.json", "w") as fh:
        for doc in docs:
            fh.write(json.dumps(doc) + "\n")
    return releases(read_package_lines(spark, d))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(question, max_size=5)), min_size=20, max_size=60))
def test_unanswered_wide_matches_spec(spark, lists):
    docs = [{"releases": [{"ocid": str(i), "tender": ({} if qs is None else {"enquiries": qs})}]}
            for i, qs in enumerate(lists)]
    r = _read(spark, docs).select(F.col("ocid").cast("int").alias("i"),
                                  N.unanswered_wide(F.col("tender.enquiries")).alias("n"))
    got = {row.i: row.n for row in r.collect()}
    assert [got[i] for i in range(len(lists))] == [unanswered_wide_spec(qs) for qs in lists]


bid = st.fixed_dictionaries({"date": st.sampled_from(["2022-01-01T00:00:00-05:00",
                                                      "2022-03-01T00:00:00-05:00", None])},
                            optional={"tenderers": st.sampled_from([[], [{"id": "t", "name": "n"}]]),
                                      "value": st.just({"amount": 1.0})})
CLOSE = datetime(2022, 2, 1, tzinfo=timezone(timedelta(hours=-5)))


def late_bids_spec(bids, close):
    """Nf030 over plain dicts: NULL for no bids or a bid without tenderer or
    value; otherwise bids dated strictly after the close (NULL close: 0)."""
    if not bids:
        return None
    if any(not b.get("tenderers") or b.get("value") is None for b in bids):
        return None
    return sum(1 for b in bids
               if close is not None and b["date"] is not None
               and datetime.fromisoformat(b["date"]) > close)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.lists(bid, max_size=4)), st.booleans()),
                min_size=20, max_size=60))
def test_late_bids_matches_spec(spark, cases):
    docs = [{"releases": [{"ocid": str(i), "auctions": [{
        "period": {"endDate": CLOSE.isoformat() if has_close else None},
        "stages": [{"bids": bids}]}]}]} for i, (bids, has_close) in enumerate(cases)]
    stage = F.get(F.get(F.col("auctions"), 0)["stages"], 0)
    r = _read(spark, docs).select(
        F.col("ocid").cast("int").alias("i"),
        N.late_bids(stage["bids"], F.get(F.col("auctions"), 0)["period"]["endDate"]).alias("n"))
    got = {row.i: row.n for row in r.collect()}
    want = [late_bids_spec(b, CLOSE if c else None) for b, c in cases]
    assert [got[i] for i in range(len(cases))] == want


DATES = [None, "2022-01-01T00:00:00-05:00", "2022-01-03T12:00:00-05:00", "2022-01-09T23:00:00-03:00"]
full_q = st.fixed_dictionaries(
    {"description": st.sampled_from([None, "pregunta", "Convalidación x", "CONVALIDA convalidar",
                                     "convalidar"]),
     "answer": st.sampled_from([None, "ok"]),
     "date": st.sampled_from(DATES), "dateAnswered": st.sampled_from(DATES)},
    optional={"author": st.one_of(st.none(), st.fixed_dictionaries(
        {}, optional={"id": st.sampled_from(["E1", "S2", "xE1y", None])}))})
DEADLINE = "2022-01-05T00:00:00-05:00"


def _ts(s):
    return datetime.fromisoformat(s)


def narrow_spec(qs, ent):
    if not qs or ent is None or any(q.get("author") is None for q in qs):
        return None
    kept = [q for q in qs if q["description"] is not None]
    if any(q["author"].get("id") is None for q in kept):
        return None
    kept = [q for q in kept if ent not in q["author"]["id"] and not re.search(T.RE_NARROW, q["description"])]
    return sum(1 for q in kept if q["answer"] is None)


def mean_spec(qs):
    if not qs or any(q["date"] is None or q["dateAnswered"] is None for q in qs):
        return None
    days = [(_ts(q["dateAnswered"]) - _ts(q["date"])).days for q in qs]
    return sum(days) / len(days)


def late_spec(qs, end):
    n = 0
    for q in qs or []:
        if q["date"] is not None and end is not None and _ts(q["date"]) <= _ts(end):
            continue
        if q["description"] is not None and len(re.findall(T.RE_WIDE, q["description"])) != 1:
            n += 1
    return n


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.lists(full_q, max_size=4)),
                          st.sampled_from(["E1", None]), st.sampled_from([DEADLINE, None])),
                min_size=20, max_size=60))
def test_question_measures_match_spec(spark, cases):
    docs = [{"releases": [{"ocid": str(i), "tender": {
        "procuringEntity": {"id": ent}, "enquiryPeriod": {"endDate": end},
        **({} if qs is None else {"enquiries": qs})}}]} for i, (qs, ent, end) in enumerate(cases)]
    t = F.col("tender")
    q = N.typed_enquiries(t["enquiries"])
    r = _read(spark, docs).select(
        F.col("ocid").cast("int").alias("i"),
        N.unanswered_narrow(q, t["procuringEntity"]["id"]).alias("narrow"),
        N.mean_response_days(q).alias("mean"),
        N.late_questions(q, N.instant(t["enquiryPeriod"]["endDate"])).alias("late"))
    got = {row.i: (row.narrow, row.mean, row.late) for row in r.collect()}
    for i, (qs, ent, end) in enumerate(cases):
        assert got[i] == (narrow_spec(qs, ent), mean_spec(qs), late_spec(qs, end)), (qs, ent, end)


field = st.text(alphabet="ab 1-", min_size=1, max_size=6).filter(lambda s: s.strip() != "")


def parse_spec(frag):
    lines = re.sub(r"<[^>]+>", "", frag).splitlines()
    lines[-1] = lines[-1].replace("&nbsp;", "")
    link = T.HARVEST_BASE_URL + re.findall(r'(?<=href=").*(?=,">)', frag)[0]
    out = ([link] + lines[1:])[:8]
    out[1] = out[1].replace(" ", "")
    return out


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 999), st.lists(field, min_size=7, max_size=9)),
                min_size=10, max_size=40))
def test_fragment_parsing_matches_spec(spark, cases):
    from pliego.operators.harvest import parse_fragments
    frags = [f'<td>\n<a href="info.cpe?id={k},">{fs[0]}</a>\n<b>' + "\n".join(fs[1:]) + "</b>&nbsp;"
             for k, fs in cases]
    df = spark.createDataFrame(list(enumerate(frags)), "page_id long, fragment string")
    got = {r.page_id: [r[c] for c in T.HARVEST_COLUMNS] for r in parse_fragments(df).collect()}
    assert [got[i] for i in range(len(frags))] == [parse_spec(f) for f in frags]


NAIVE = [None, datetime(2022, 1, 1), datetime(2022, 1, 3, 12), datetime(2022, 1, 9, 23)]
flat_q = st.tuples(st.sampled_from([None, "pregunta", "Convalidación x", "CONVALIDA convalidar", "convalidar"]),
                   st.sampled_from([None, "ok"]), st.sampled_from(["E1", "S2", "xE1y", None]),
                   st.sampled_from(NAIVE), st.sampled_from(NAIVE))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.lists(flat_q, min_size=1, max_size=4), st.sampled_from(["E1", None]),
                          st.sampled_from([datetime(2022, 1, 5), None])), min_size=10, max_size=40))
def test_flat_question_aggregates_match_spec(spark, tenders):
    from pliego.operators.enquiries import enquiry_stats
    q_rows = [(k, d, a, au, t0, t1) for k, (qs, _, _) in enumerate(tenders) for d, a, au, t0, t1 in qs]
    t_rows = [(k, ent, end) for k, (_, ent, end) in enumerate(tenders)]
    q = spark.createDataFrame(q_rows, "tender_key long, description string, answer string, author_id string, "
                                      "asked_ts timestamp_ntz, answered_ts timestamp_ntz")
    t = spark.createDataFrame(t_rows, "tender_key long, in_ent string, enq_end timestamp_ntz")
    got = {r.tender_key: (r.unanswered_narrow, r.mean_response_days, r.late_questions, r.unanswered_wide)
           for r in enquiry_stats(q, t).collect()}
    for k, (qs, ent, end) in enumerate(tenders):
        dicts = [{"description": d, "answer": a, "author": {"id": au},
                  "date": t0.isoformat() if t0 else None, "dateAnswered": t1.isoformat() if t1 else None}
                 for d, a, au, t0, t1 in qs]
        want = (narrow_spec(dicts, ent), mean_spec(dicts),
                late_spec(dicts, end.isoformat() if end else None), unanswered_wide_spec(dicts))
        assert got[k] == want, (qs, ent, end)


flat_bid = st.tuples(st.sampled_from([None, datetime(2022, 1, 1), datetime(2022, 3, 1)]),
                     st.sampled_from([7, None]), st.sampled_from([1.0, None]))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.lists(flat_bid, min_size=1, max_size=4),
                          st.sampled_from([datetime(2022, 2, 1), None])), min_size=10, max_size=40))
def test_flat_bid_aggregates_match_spec(spark, tenders):
    from pliego.operators.bids import bid_stats
    b = spark.createDataFrame([(k, ts, who, amt, who is None, amt is None) for k, (bs, _) in enumerate(tenders) for ts, who, amt in bs],
                              "tender_key long, bid_ts timestamp_ntz, tenderer_id long, amount double, "
                              "tenderer_missing boolean, value_missing boolean")
    t = spark.createDataFrame([(k, c) for k, (_, c) in enumerate(tenders)],
                              "tender_key long, close_ts timestamp_ntz")
    got = {r.tender_key: (r.NF018, r.Nf030) for r in bid_stats(b, t).collect()}
    for k, (bs, close) in enumerate(tenders):
        dicts = [{"date": ts.isoformat() if ts else None, "value": {"amount": amt} if amt is not None else None,
                  "tenderers": [{"id": who}] if who is not None else None} for ts, who, amt in bs]
        want_late = late_bids_spec(dicts, close)
        assert got[k] == (len(bs), want_late), (bs, close)


feature_value = st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.5, 1.5, 2.5, 10.5, 30.5]),
                          st.floats(-5, 60, allow_nan=False))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(*[feature_value] * 6), min_size=20, max_size=80))
def test_case_expression_equals_python_model(spark, rows):
    import math as _m

    from pliego.operators.scoring import FEATURES, TreeEnsembleModel, ensemble_sql, score
    schema = "ocid string, " + ", ".join(f"{f} double" for f in FEATURES)
    df = spark.createDataFrame([(str(i),) + r for i, r in enumerate(rows)], schema)
    got = {r.ocid: round(r.proba, 9) for r in score(df).collect()}
    X = [[_m.nan if v is None else v for v in r] for r in rows]
    p = TreeEnsembleModel().predict_proba(X)[:, 1]
    assert [got[str(i)] for i in range(len(rows))] == [round(float(x), 9) for x in p]
    df.createOrReplaceTempView("prop_feat")
    m = {r.ocid: r.m for r in spark.sql(f"SELECT ocid, {ensemble_sql()} AS m FROM prop_feat").collect()}
    assert [round(1 / (1 + _m.exp(-m[str(i)])), 9) for i in range(len(rows))] == [got[str(i)] for i in range(len(rows))]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="ab/:.-", max_size=15), min_size=20, max_size=80))
def test_url_tail_matches_search_semantics(spark, urls):
    def want(u):
        m = re.search(r"(?<=/)[^/]*$", u)
        return m.group(0) if m and m.group(0) else None
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(T.url_tail("u")).collect()] == [want(u) for u in urls]
