"""Independent DuckDB SQL for every checked query.

Each query in ``registry`` has SQL here that DuckDB runs on the same parquet
tables; the fixture views are inlined as CTEs.  Dialect notes: DuckDB's regex
engine has no look-around, ``epoch_us`` gives exact microsecond differences,
and counts / years are cast to BIGINT on both sides.
"""
from __future__ import annotations

from ..functions.text import HARVEST_BASE_URL, RE_NARROW, RE_WIDE
from .views import TEST_METHOD

TOPIC = "[Ll]icen[cs]e|[Cc]opyright|LICENSE "
WIDE = RE_WIDE.replace("'", "''")
NARROW = RE_NARROW.replace("'", "''")


def floor_days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0::DOUBLE) AS BIGINT)"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 3600000000.0::DOUBLE)"


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 60000000.0::DOUBLE)"


VIEWS = {
    "tender_v": """
SELECT o_orderkey AS tender_key,
       concat('ocds-5wno2w-SIE-', o_orderkey, '-', year(o_orderdate), '-', o_custkey) AS ocid,
       o_orderpriority AS method, concat('E', o_orderkey % 10) AS in_ent,
       o_custkey AS buyer_key,
       o_orderdate AS start_ts,
       o_orderdate + (o_orderkey % 17) * INTERVAL '1' HOUR AS enq_start,
       o_orderdate + (o_custkey % 20 - 5) * INTERVAL '1' DAY + (o_orderkey % 24) * INTERVAL '1' HOUR AS enq_end,
       o_orderdate + (o_custkey % 30) * INTERVAL '1' DAY AS award_start,
       o_orderdate + (o_custkey % 45) * INTERVAL '1' DAY AS award_end,
       o_orderdate + (o_orderkey % 72) * INTERVAL '1' HOUR AS auction_start,
       o_orderdate + INTERVAL '365' DAY AS close_ts,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + (o_custkey % 45) * INTERVAL '1' DAY
            + (o_orderkey % 50 - 5) * INTERVAL '1' HOUR END AS signed_ts,
       o_totalprice AS contract_value, o_totalprice - (o_custkey % 100) AS award_value,
       CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 7 END AS n_tenderers
FROM orders""",
    "bids_v": """
SELECT l_orderkey AS tender_key, l_shipdate AS bid_ts, l_suppkey AS tenderer_id,
       l_extendedprice AS amount, l_partkey, l_linenumber, l_quantity, l_discount, l_tax,
       l_returnflag, l_linestatus
FROM lineitem""",
    "enq_v": """
SELECT q.conv_id AS tender_key, q.turn AS enq_no,
       CASE WHEN q.turn % 3 = 0 THEN concat('E', q.conv_id % 10) ELSE concat('S', q.turn) END AS author_id,
       CASE WHEN (q.conv_id + q.turn) % 5 = 0 THEN concat('CONVALIDACION ', q.text)
            WHEN (q.conv_id + q.turn) % 7 = 0 THEN 'CONVALIDA convalidar'
            WHEN (q.conv_id + q.turn) % 11 = 0 THEN concat('convalidación, ', q.text)
            ELSE q.text END AS description,
       CASE WHEN a.role = 'assistant' THEN a.text END AS answer,
       o_orderdate + ((q.turn * 37 + q.conv_id) % 400) * INTERVAL '1' HOUR AS asked_ts,
       CASE WHEN a.role = 'assistant' THEN o_orderdate
            + ((q.turn * 37 + q.conv_id) % 400 + (q.turn * 13 + q.conv_id) % 90 - 10) * INTERVAL '1' HOUR
       END AS answered_ts
FROM conversations q
LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
JOIN orders ON o_orderkey = q.conv_id
WHERE q.role = 'user'""",
    "harvest_v": """
SELECT page_id, concat('<td>', chr(10), '<a href="info.cpe?id=', page_id, ',">SIE-', page_id, ' -',
       year(o_orderdate), '</a>', chr(10), 'ENT ', o_custkey % 10, chr(10), o_orderpriority, chr(10),
       CASE WHEN o_orderkey % 3 = 0 THEN 'Desierta' ELSE 'Adjudicada' END, chr(10),
       'P', o_custkey % 24, chr(10), CAST(floor(o_totalprice) AS BIGINT), chr(10),
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '&nbsp;') AS fragment
FROM pages JOIN orders ON o_orderkey = page_id""",
}

# Derived CTEs, in dependency order.
DERIVED = {
    "enq_stats": f"""
SELECT e.tender_key,
       count(*) AS n_questions,
       count(*) FILTER (WHERE description IS NOT NULL AND description <> '') AS num_pregu,
       count(*) FILTER (WHERE answer IS NOT NULL AND answer <> '') AS num_respu,
       CASE WHEN count(description) = count(*) THEN
            count(*) FILTER (WHERE NOT regexp_matches(description, '{WIDE}') AND answer IS NULL) END
         AS unanswered_wide,
       CASE WHEN count({floor_days('answered_ts', 'asked_ts')}) = count(*)
            THEN avg({floor_days('answered_ts', 'asked_ts')}) END AS mean_response_days,
       count(*) FILTER (WHERE NOT coalesce(asked_ts <= t.enq_end, false)
                          AND len(regexp_extract_all(description, '{WIDE}')) <> 1) AS late_questions,
       CASE WHEN NOT (bool_or(t.in_ent IS NULL) OR bool_or(description IS NOT NULL AND author_id IS NULL))
            THEN count(*) FILTER (WHERE description IS NOT NULL AND NOT contains(author_id, t.in_ent)
                                    AND NOT regexp_matches(description, '{NARROW}') AND answer IS NULL)
       END AS unanswered_narrow
FROM enq_v e JOIN tender_v t ON t.tender_key = e.tender_key
GROUP BY e.tender_key""",
    "bid_stats": """
SELECT b.tender_key, count(*) AS NF018,
       CASE WHEN bool_or(tenderer_id IS NULL OR amount IS NULL) THEN NULL
            ELSE count(*) FILTER (WHERE bid_ts > t.close_ts) END AS Nf030
FROM bids_v b JOIN tender_v t ON t.tender_key = b.tender_key
GROUP BY b.tender_key""",
    "flags_v": f"""
SELECT t.ocid, t.tender_key, t.method, t.in_ent,
       CAST(year(t.start_ts) AS BIGINT) AS Year,
       {floor_days('t.award_end', 't.start_ts')} AS Dif_Day_Recep_Ofer,
       {floor_days('t.enq_end', 't.enq_start')} AS enqui_perio,
       {minutes('t.close_ts', 't.auction_start')} AS audi_perio,
       {floor_days('t.award_end', 't.award_start')} AS awar_perio,
       q.n_questions AS Number_ques, q.num_pregu AS Num_Pregu, q.num_respu AS Num_Respu,
       q.num_pregu - q.num_respu AS Pre_No_Respu, q.mean_response_days AS Mean_Days_Respon,
       {hours('t.signed_ts', 't.award_end')} AS nf061,
       t.contract_value - t.award_value AS nf059,
       q.unanswered_narrow AS NF039, b.NF018, b.Nf030
FROM tender_v t
LEFT JOIN enq_stats q ON q.tender_key = t.tender_key
LEFT JOIN bid_stats b ON b.tender_key = t.tender_key""",
}

DERIVED["harvest_p"] = f"""
SELECT page_id,
       CASE WHEN regexp_matches(fragment, 'href="(.*),">')
            THEN concat('{HARVEST_BASE_URL}', regexp_extract(fragment, 'href="(.*),">', 1)) END AS link,
       replace(l[2], ' ', '') AS codigo, l[3] AS entidad_contratante, l[4] AS objeto_del_proceso,
       l[5] AS estado_del_proceso, l[6] AS provincia_canton, l[7] AS presupuesto,
       replace(l[8], '&nbsp;', '') AS publish_date
FROM (SELECT page_id, fragment,
             string_split(regexp_replace(fragment, '<[^>]+>', '', 'g'), chr(10)) AS l FROM harvest_v)"""
DERIVED["codes"] = """
SELECT ocid, nullif(regexp_extract(ocid, '^ocds-5wno2w-(.+)-', 1), '') AS codigo,
       CAST(year(start_ts) AS BIGINT) AS Year
FROM tender_v"""
DERIVED["first_match"] = """
SELECT codigo, Year, CAST(make_date(CAST(Year AS INTEGER), half * 6 + 1, 1) AS DATE) AS window_start,
       CAST(make_date(CAST(Year AS INTEGER), half * 6 + 1, 1) + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE)
         AS window_end,
       page_id, link, entidad_contratante, objeto_del_proceso, estado_del_proceso, provincia_canton,
       presupuesto, publish_date
FROM (SELECT h.*, CAST(year(pub) AS BIGINT) AS Year, CASE WHEN month(pub) <= 6 THEN 0 ELSE 1 END AS half,
             row_number() OVER (PARTITION BY codigo, year(pub)
                                ORDER BY CASE WHEN month(pub) <= 6 THEN 0 ELSE 1 END, pub, page_id) AS rn
      FROM (SELECT *, TRY_CAST(publish_date AS DATE) AS pub FROM harvest_p) h
      WHERE pub IS NOT NULL
        AND (codigo, CAST(year(pub) AS BIGINT)) IN (SELECT (codigo, Year) FROM codes))
WHERE rn = 1"""



def features_sql(where: str = f"t.method = '{TEST_METHOD}'", late: str = "coalesce(q.late_questions, 0)",
                 unanswered: str = "q.unanswered_wide") -> str:
    return f"""
SELECT t.ocid,
       CAST({floor_days('t.award_end', 't.award_start')} AS DOUBLE) AS awar_perio,
       CAST({unanswered} AS DOUBLE) AS Pre_No_Respu,
       CAST({floor_days('t.enq_end', 't.enq_start')} AS DOUBLE) AS enqui_perio,
       CAST(q.n_questions AS DOUBLE) AS Number_ques,
       CAST({late} AS DOUBLE) AS NF039,
       CAST(t.n_tenderers AS DOUBLE) AS n_of_Tend
FROM tender_v t LEFT JOIN enq_stats q ON q.tender_key = t.tender_key
WHERE {where}"""


# The three trees of the stand-in model, written out: a missing value goes the way the comment says.
TREES = """
  CASE WHEN coalesce(n_of_Tend, 0) < 1.5                             -- missing: fewer
       THEN CASE WHEN coalesce(Pre_No_Respu, 0) < 0.5 THEN 0.35::DOUBLE ELSE 0.8::DOUBLE END     -- missing: fewer
       ELSE CASE WHEN coalesce(awar_perio, 99) < 10.5 THEN -0.6::DOUBLE ELSE -0.1::DOUBLE END    -- missing: more
  END
+ CASE WHEN coalesce(NF039, 0) < 0.5                                 -- missing: fewer
       THEN CASE WHEN coalesce(enqui_perio, 99) < 2.5 THEN 0.25::DOUBLE ELSE -0.3::DOUBLE END    -- missing: more
       ELSE 0.45::DOUBLE
  END
+ CASE WHEN coalesce(Number_ques, 0) < 0.5 THEN -0.15::DOUBLE        -- missing: fewer
       ELSE CASE WHEN coalesce(awar_perio, 0) < 30.5 THEN 0.05::DOUBLE ELSE 0.3::DOUBLE END      -- missing: fewer
  END"""


def scored_sql(src: str, extra: str = "") -> str:
    return f"""
SELECT ocid, CAST(raw > 0.5 AS BIGINT) AS predict, CAST(CAST(raw AS DECIMAL(18, 9)) AS DOUBLE) AS proba, n_of_Tend,
       Pre_No_Respu, awar_perio, enqui_perio, Number_ques, NF039{extra}
FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({TREES}))) AS raw FROM {src})"""


# Landed packages omit the answer key of unanswered questions with
# enq_no % 4 = 1; only explicit nulls count, and a tender none of whose
# questions has the key counts all its questions.
DERIVED["enq_pkg"] = f"""
SELECT tender_key,
       CASE WHEN count(*) FILTER (WHERE has_key) = 0 THEN count(*)
            WHEN count(description) < count(*) THEN NULL
            ELSE count(*) FILTER (WHERE has_key AND answer IS NULL
                                    AND NOT regexp_matches(description, '{WIDE}')) END AS unanswered_pkg
FROM (SELECT *, NOT (answer IS NULL AND enq_no % 4 = 1) AS has_key FROM enq_v)
GROUP BY tender_key"""
DERIVED["feat"] = features_sql()
DERIVED["feat_zero"] = features_sql(late="0")
DERIVED["feat_pkg"] = features_sql(unanswered="p.unanswered_pkg").replace(
    "LEFT JOIN enq_stats q ON q.tender_key = t.tender_key",
    "LEFT JOIN enq_stats q ON q.tender_key = t.tender_key LEFT JOIN enq_pkg p ON p.tender_key = t.tender_key")
DERIVED["scored"] = scored_sql("feat")
DERIVED["scored_pkg"] = scored_sql("feat_pkg")
DERIVED["scored_zero"] = scored_sql("feat_zero")
DERIVED["harvest_1"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY TRY_CAST(publish_date AS DATE) NULLS LAST, page_id) AS rn
  FROM harvest_p) WHERE rn = 1"""
DERIVED["status"] = """
SELECT c.ocid, h.estado_del_proceso AS Estado, h.link AS Link
FROM codes c JOIN harvest_1 h ON h.codigo = c.codigo"""
DERIVED["scored_status"] = scored_sql(
    "(SELECT f.*, s.Estado, s.Link FROM feat f JOIN status s ON s.ocid = f.ocid)", ", Estado, Link")

_DEPS = {
    "feat": ["tender_v", "enq_stats"], "feat_zero": ["tender_v", "enq_stats"],
    "enq_pkg": ["enq_v"], "feat_pkg": ["tender_v", "enq_stats", "enq_pkg"], "scored_pkg": ["feat_pkg"],
    "scored": ["feat"], "scored_zero": ["feat_zero"],
    "harvest_1": ["harvest_p"], "status": ["codes", "harvest_1"], "scored_status": ["feat", "status"],
    "harvest_p": ["harvest_v"], "codes": ["tender_v"],
    "first_match": ["harvest_p", "codes"],
    "tender_v": [], "bids_v": [], "enq_v": [], "harvest_v": [],
    "enq_stats": ["enq_v", "tender_v"],
    "bid_stats": ["bids_v", "tender_v"],
    "flags_v": ["tender_v", "enq_stats", "bid_stats"],
}


def with_ctes(body: str, *names: str) -> str:
    """``WITH`` the named views (and what they depend on), then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    defs = {**VIEWS, **DERIVED}
    ctes = ",\n".join(f"{n} AS ({defs[n]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


RED_FLAG_COLS = ("ocid, tender_key, in_ent, Year, Dif_Day_Recep_Ofer, enqui_perio, audi_perio, "
                 "awar_perio, Number_ques, Num_Pregu, Num_Respu, Pre_No_Respu, Mean_Days_Respon, "
                 "nf061, nf059, NF039, NF018, Nf030")

SQL: dict[str, str] = {}

SQL["red_flags_full"] = with_ctes(
    f"SELECT {RED_FLAG_COLS} FROM flags_v WHERE method = '{TEST_METHOD}'", "flags_v")
SQL["red_flags"] = with_ctes(
    "SELECT ocid, tender_key, nf061, nf059, NF039, NF018, Nf030 FROM flags_v", "flags_v")
SQL["derived"] = with_ctes(
    "SELECT ocid, tender_key, Year, Dif_Day_Recep_Ofer, enqui_perio, audi_perio, awar_perio, "
    "Number_ques, Num_Pregu, Num_Respu, Pre_No_Respu, Mean_Days_Respon "
    f"FROM flags_v WHERE method = '{TEST_METHOD}'", "flags_v")
SQL["filter_method"] = with_ctes(
    f"SELECT tender_key, ocid, method FROM tender_v WHERE method = '{TEST_METHOD}'", "tender_v")
SQL["floor_days"] = with_ctes(
    f"""SELECT tender_key, {floor_days('enq_end', 'enq_start')} AS enqui_perio,
       {floor_days('award_end', 'award_start')} AS awar_perio,
       {floor_days('award_end', 'start_ts')} AS Dif_Day_Recep_Ofer FROM tender_v""", "tender_v")
SQL["auction_minutes"] = with_ctes(
    f"SELECT tender_key, {minutes('close_ts', 'auction_start')} AS audi_perio FROM tender_v",
    "tender_v")
SQL["sign_hours"] = with_ctes(
    f"SELECT tender_key, {hours('signed_ts', 'award_end')} AS nf061 FROM tender_v", "tender_v")
SQL["value_gap"] = with_ctes(
    "SELECT tender_key, contract_value - award_value AS nf059 FROM tender_v", "tender_v")
SQL["tender_year"] = with_ctes(
    """SELECT tender_key, CAST(year(start_ts) AS BIGINT) AS Year,
       CAST(year(start_ts) AS BIGINT) AS year_cast,
       CAST(year(enq_end) AS BIGINT) AS enq_end_year FROM tender_v""", "tender_v")
SQL["bid_count"] = with_ctes(
    "SELECT tender_key, count(*) AS NF018 FROM bids_v GROUP BY tender_key", "bids_v")
SQL["late_bids"] = with_ctes(
    "SELECT t.tender_key, b.NF018, b.Nf030 FROM tender_v t "
    "LEFT JOIN bid_stats b ON b.tender_key = t.tender_key", "tender_v", "bid_stats")
SQL["array_len"] = with_ctes(
    "SELECT tender_key, n_questions AS Number_ques FROM enq_stats", "enq_stats")
SQL["qa_gap"] = with_ctes(
    "SELECT tender_key, n_questions AS Number_ques, num_pregu AS Num_Pregu, "
    "num_respu AS Num_Respu, num_pregu - num_respu AS Pre_No_Respu FROM enq_stats", "enq_stats")
SQL["unanswered_wide"] = with_ctes(
    "SELECT tender_key, unanswered_wide AS Pre_No_Respu FROM enq_stats", "enq_stats")
SQL["mean_response_days"] = with_ctes(
    "SELECT tender_key, mean_response_days AS Mean_Days_Respon FROM enq_stats", "enq_stats")
SQL["late_questions"] = with_ctes(
    "SELECT tender_key, late_questions AS NF039 FROM enq_stats", "enq_stats")
SQL["unanswered_narrow"] = with_ctes(
    "SELECT tender_key, unanswered_narrow AS NF039 FROM enq_stats", "enq_stats")

SQL["topic_wide"] = with_ctes(
    f"""SELECT tender_key, enq_no, regexp_matches(description, '{WIDE}') AS wide_hit,
       CAST(len(regexp_extract_all(description, '{WIDE}')) AS BIGINT) AS wide_count FROM enq_v""",
    "enq_v")
SQL["topic_narrow"] = with_ctes(
    f"SELECT tender_key, enq_no, regexp_matches(description, '{NARROW}') AS narrow_hit FROM enq_v",
    "enq_v")
SQL["topic_documents"] = (
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{WIDE}')) AS BIGINT) AS wide_count,
       regexp_matches(text, '{NARROW}') AS narrow_hit,
       CAST(len(regexp_extract_all(text, '{TOPIC}')) AS BIGINT) AS topic_count,
       regexp_matches(text, '{TOPIC}') AS topic_hit FROM documents""")
SQL["process_code"] = with_ctes(
    "SELECT tender_key, ocid, nullif(regexp_extract(ocid, '^ocds-5wno2w-(.+)-', 1), '') AS codigo "
    "FROM tender_v", "tender_v")
SQL["url_tail"] = "SELECT page_id, nullif(regexp_extract(url, '/([^/]*)$', 1), '') AS tail FROM pages"
SQL["strip_tags"] = "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages"
SQL["harvest_link"] = with_ctes("SELECT page_id, link FROM harvest_p", "harvest_p")
SQL["harvest_parse"] = with_ctes("SELECT * FROM harvest_p", "harvest_p")
SQL["harvest_join"] = with_ctes(
    "SELECT c.ocid, c.Year, h.* FROM codes c JOIN harvest_1 h ON h.codigo = c.codigo",
    "codes", "harvest_1")
SQL["window_first_match"] = with_ctes("SELECT * FROM first_match", "first_match")
SQL["harvest_found"] = with_ctes(
    "SELECT * FROM codes c WHERE (c.codigo, c.Year) IN (SELECT (codigo, Year) FROM first_match)",
    "codes", "first_match")

SQL["features"] = with_ctes("SELECT * FROM feat", "feat")
SQL["score_trees"] = with_ctes("SELECT * FROM scored", "scored")
SQL["score_udf"] = SQL["score_trees"]
SQL["score_table"] = SQL["score_trees"]
SQL["tender_card"] = with_ctes(
    """SELECT ocid, CASE WHEN predict = 1 THEN 'Desierto' ELSE 'Normal' END AS prediction,
       CAST(CAST(proba * 100 AS DECIMAL(18, 2)) AS DOUBLE) AS probability_pct,
       coalesce(CAST(n_of_Tend AS VARCHAR), 'Sin Registro') AS tenderers,
       coalesce(CAST(Pre_No_Respu AS VARCHAR), 'Sin Registro') AS unanswered,
       CAST(round(awar_perio) AS BIGINT) AS award_days,
       CAST(round(enqui_perio) AS BIGINT) AS enquiry_days
FROM scored""", "scored")
SQL["score_status"] = with_ctes("SELECT * FROM scored_status", "scored_status")
SQL["highlight_flags"] = with_ctes(
    "SELECT ocid, predict > 0 AS flagged, n_of_Tend = 1 AS single_bidder, "
    "Estado = 'Desierta' AS deserted FROM scored_status", "scored_status")

_IDS = f"SELECT min(ocid) FROM tender_v WHERE method {{}} '{TEST_METHOD}'"
SQL["lookup_scored"] = with_ctes(
    f"SELECT * FROM scored WHERE ocid = ({_IDS.format('=')}) OR ocid = ({_IDS.format('<>')})", "tender_v", "scored")
SQL["lookup_any"] = with_ctes(
    f"SELECT {RED_FLAG_COLS} FROM flags_v WHERE ocid = ({_IDS.format('<>')})", "tender_v", "flags_v")
SQL["outlier_lookup"] = with_ctes(
    "SELECT c.ocid, c.codigo, c.Year, s.predict, s.proba FROM codes c JOIN scored s ON s.ocid = c.ocid",
    "codes", "scored")
_DIFF_COLS = ["predict", "proba", "awar_perio", "Pre_No_Respu", "enqui_perio", "Number_ques", "NF039",
              "n_of_Tend"]
SQL["prediction_diff"] = with_ctes(
    "SELECT a.ocid, " + ", ".join(f"a.{c} AS {c}_self, b.{c} AS {c}_other" for c in _DIFF_COLS)
    + " FROM scored a JOIN scored_zero b ON a.ocid = b.ocid WHERE "
    + " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _DIFF_COLS),
    "scored", "scored_zero")


def iso(c: str) -> str:
    return f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || '-05:00')"


DERIVED["bid_n"] = "SELECT tender_key, count(*) AS NF018 FROM bids_v GROUP BY tender_key"
_DEPS["bid_n"] = ["bids_v"]
_TENDER_ROWS = with_ctes(
    f"""SELECT t.ocid, t.method AS PMethoDetails, t.in_ent, {iso('t.start_ts')} AS TTPSDate, b.NF018,
       q.n_questions AS Number_ques
FROM tender_v t LEFT JOIN bid_n b ON b.tender_key = t.tender_key
LEFT JOIN enq_stats q ON q.tender_key = t.tender_key""", "tender_v", "bid_n", "enq_stats")
SQL["scan_lines"] = SQL["scan_package"] = SQL["scan_zip"] = _TENDER_ROWS
SQL["view_sql"] = with_ctes(
    f"""SELECT t.ocid, t.method AS PMethoDetails, t.in_ent, {iso('t.start_ts')} AS TTPSDate,
       t.award_value AS awardsvalue, t.contract_value AS ContractValue, b.NF018,
       CAST(year(t.start_ts) AS BIGINT) AS year
FROM tender_v t LEFT JOIN bid_n b ON b.tender_key = t.tender_key""", "tender_v", "bid_n")
SQL["explode_releases"] = with_ctes(
    """SELECT ocid, CAST(tender_key AS VARCHAR) AS tender_id, 'tender' AS tag,
       CASE WHEN tender_key % 2 = 0 THEN 'goods' ELSE 'services' END AS category FROM tender_v""",
    "tender_v")
SQL["first_element"] = with_ctes(
    f"""SELECT ocid, {iso('start_ts')} AS date, contract_value AS PreRefe, in_ent,
       CAST(tender_key AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS description, contract_value AS Tvalue,
       'Entidad ' || in_ent AS enti_name, method AS PMethoDetails, {iso('start_ts')} AS TTPSDate,
       {iso('close_ts')} AS TTPEDate, {iso('enq_start')} AS TEPSDate, {iso('enq_end')} AS TEPEDate,
       {iso('award_start')} AS TAPSDate, {iso('award_end')} AS TAPEDate, n_tenderers AS n_of_Tend,
       CAST(year(start_ts) AS BIGINT) AS year
FROM tender_v""", "tender_v")
SQL["first_nested"] = with_ctes(
    f"""SELECT t.ocid, {iso('t.award_end')} AS awardsDate, t.award_value AS awardsvalue,
       {iso('t.award_end')} AS ACPSDate, {iso('t.close_ts')} AS ACPEDate, 'P' || t.buyer_key AS award_id,
       {iso('t.signed_ts')} AS CCPSDate, {iso('t.close_ts')} AS CCPEDate, t.contract_value AS ContractValue,
       {iso('t.signed_ts')} AS dateSigned, {iso('t.auction_start')} AS bid_st_Date,
       {iso('t.close_ts')} AS bid_en_Date, b.NF018
FROM tender_v t LEFT JOIN bid_n b ON b.tender_key = t.tender_key""", "tender_v", "bid_n")
SQL["array_field"] = with_ctes(
    f"""SELECT t.ocid, q.enq_desc, q.enq_ans, q.enq_fechas,
       CASE WHEN t.tender_key % 2 = 0 THEN 'goods' ELSE 'services' END AS category
FROM tender_v t LEFT JOIN (
  SELECT tender_key, string_agg(description, '|' ORDER BY description) AS enq_desc,
         string_agg(answer, '|' ORDER BY answer) AS enq_ans,
         string_agg({iso('asked_ts')}, '|' ORDER BY {iso('asked_ts')}) AS enq_fechas
  FROM enq_v GROUP BY tender_key) q ON q.tender_key = t.tender_key""", "tender_v", "enq_v")
SQL["flatten_struct"] = with_ctes(
    f"""SELECT ocid, {iso('start_ts')} AS date, contract_value AS planning__budget__amount__amount,
       'USD' AS planning__budget__amount__currency, CAST(tender_key AS VARCHAR) AS tender__id,
       CAST(NULL AS VARCHAR) AS tender__description, method AS tender__procurementMethodDetails,
       CASE WHEN tender_key % 2 = 0 THEN 'goods' ELSE 'services' END AS tender__mainProcurementCategory,
       n_tenderers AS tender__numberOfTenderers, in_ent AS tender__procuringEntity__id,
       'Entidad ' || in_ent AS tender__procuringEntity__name, contract_value AS tender__value__amount,
       'USD' AS tender__value__currency, {iso('start_ts')} AS tender__tenderPeriod__startDate,
       {iso('close_ts')} AS tender__tenderPeriod__endDate, {iso('enq_start')} AS tender__enquiryPeriod__startDate,
       {iso('enq_end')} AS tender__enquiryPeriod__endDate, {iso('award_start')} AS tender__awardPeriod__startDate,
       {iso('award_end')} AS tender__awardPeriod__endDate
FROM tender_v""", "tender_v")
_US5H = "18000000000"
_pd_cols = {"date": "start_ts", "TTPSDate": "start_ts", "TTPEDate": "close_ts", "TEPSDate": "enq_start",
            "TEPEDate": "enq_end", "TAPSDate": "award_start", "TAPEDate": "award_end",
            "awardsDate": "award_end", "ACPSDate": "award_end", "ACPEDate": "close_ts",
            "CCPSDate": "signed_ts", "CCPEDate": "close_ts", "dateSigned": "signed_ts",
            "bid_st_Date": "auction_start", "bid_en_Date": "close_ts"}
SQL["parse_dates"] = with_ctes(
    "SELECT ocid, " + ", ".join(f"epoch_us({v}) + {_US5H} AS {k}" for k, v in _pd_cols.items())
    + " FROM tender_v", "tender_v")

SQL["bid_flat"] = with_ctes(
    f"""SELECT t.ocid, concat_ws('-', b.tender_key, b.l_linenumber, b.l_partkey) AS bid_id,
       CAST(b.tenderer_id AS VARCHAR) AS tenderer_id, 'Proveedor ' || b.tenderer_id AS tenderer_name,
       b.amount, {iso('b.bid_ts')} AS bid_date
FROM bids_v b JOIN tender_v t ON t.tender_key = b.tender_key""", "bids_v", "tender_v")
SQL["ocds_red_flags"] = with_ctes(
    "SELECT ocid, in_ent, Year, Dif_Day_Recep_Ofer, enqui_perio, audi_perio, awar_perio, Number_ques, "
    "Num_Pregu, Num_Respu, Pre_No_Respu, Mean_Days_Respon, nf061, nf059, NF039, NF018, Nf030 "
    f"FROM flags_v WHERE method = '{TEST_METHOD}'", "flags_v")
SQL["ocds_features"] = with_ctes("SELECT * FROM feat_pkg", "feat_pkg")
SQL["ocds_score"] = with_ctes("SELECT * FROM scored_pkg", "scored_pkg")
SQL["outlier_flagged"] = with_ctes(
    "SELECT c.ocid, c.codigo, c.Year, s.predict, s.proba FROM codes c JOIN scored s ON s.ocid = c.ocid "
    "WHERE s.predict = 1", "codes", "scored")
SQL["harvest_missing"] = with_ctes(
    "SELECT * FROM codes c WHERE NOT EXISTS (SELECT 1 FROM first_match m "
    "WHERE m.codigo = c.codigo AND m.Year = c.Year)", "codes", "first_match")
SQL["parquet_red_flags"] = SQL["ocds_red_flags"]
SQL["parquet_score"] = SQL["ocds_score"]

_WHOLE = ["n_of_Tend", "Pre_No_Respu", "awar_perio", "enqui_perio", "Number_ques", "NF039"]
SQL["display_table"] = with_ctes(
    "SELECT ocid, printf('%.0f', CAST(predict AS DOUBLE)) AS predict, printf('%.2f%%', proba * 100) AS proba, "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE printf('%.0f', {c}) END AS {c}" for c in _WHOLE)
    + """, Estado, '<a target="_blank" href="' || Link || '">' || Link || '</a>' AS Link FROM scored_status""",
    "scored_status")


def json_text(c: str) -> str:
    """A text as a JSON string, NULL as NULL."""
    return f"CASE WHEN {c} IS NOT NULL THEN CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR) END"


def json_object(**fields: str) -> str:
    """A JSON object of the fields (JSON texts) that are not NULL."""
    return "('{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || ({v})" for k, v in fields.items()) + ") || '}')"


def json_array(item: str, order: list[str]) -> str:
    """The JSON array of a group's items in ``order``."""
    return f"'[' || string_agg(coalesce({item}, 'null'), ',' ORDER BY {', '.join(f'{c} NULLS FIRST' for c in order)}) || ']'"


_BID_ID = "concat_ws('-', tender_key, l_linenumber, l_partkey)"
_BIDDER = json_object(id=json_text("tenderer_id"), name=json_text("('Proveedor ' || tenderer_id)"))
_BID = json_object(id=json_text(_BID_ID), date=json_text(iso("bid_ts")), tenderers=f"'[' || {_BIDDER} || ']'",
                   value=json_object(amount="CAST(amount AS VARCHAR)", currency="'\"USD\"'"))
DERIVED["bid_json"] = f"""
SELECT tender_key, {json_array(_BID, [_BID_ID, "bid_ts", "CAST(tenderer_id AS VARCHAR)", "amount"])} AS bids
FROM bids_v GROUP BY tender_key"""
_DEPS["bid_json"] = ["bids_v"]
_ASKED = {"id": "CAST(enq_no AS VARCHAR)", "description": "description", "answer": "answer", "date": iso("asked_ts"),
          "dateAnswered": iso("answered_ts")}
_QUESTION = {k: json_text(v) for k, v in _ASKED.items()} | {
    "author": json_object(id=json_text("author_id"), name=json_text("('Autor ' || author_id)"))}
DERIVED["enq_json"] = "SELECT tender_key, " + ", ".join(
    f"{json_array(item, [*_ASKED.values(), 'author_id'])} AS {name}" for name, item in {
        "enquiries": json_object(**_QUESTION), "enq_desc": _QUESTION["description"], "enq_fechas": _QUESTION["date"],
        "enq_ans_fechas": _QUESTION["dateAnswered"], "enq_ans": _QUESTION["answer"]}.items()) + " FROM enq_v GROUP BY tender_key"
_DEPS["enq_json"] = ["enq_v"]
SQL["csv_ready"] = with_ctes(
    f"""SELECT t.ocid, {iso('start_ts')} AS date, '["tender"]' AS tag, CAST(NULL AS VARCHAR) AS mc_bids, contract_value AS PreRefe,
       in_ent, CAST(t.tender_key AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS description, contract_value AS Tvalue,
       'Entidad ' || in_ent AS enti_name, method AS PMethoDetails, {iso('start_ts')} AS TTPSDate,
       {iso('close_ts')} AS TTPEDate, {iso('enq_start')} AS TEPSDate, {iso('enq_end')} AS TEPEDate,
       {iso('award_start')} AS TAPSDate, {iso('award_end')} AS TAPEDate, CAST(n_tenderers AS BIGINT) AS n_of_Tend,
       CASE WHEN t.tender_key % 2 = 0 THEN '["goods"]' ELSE '["services"]' END AS category,
       q.enquiries, q.enq_desc, q.enq_fechas, q.enq_ans_fechas, q.enq_ans,
       {iso('award_end')} AS awardsDate, award_value AS awardsvalue, {iso('award_end')} AS ACPSDate, {iso('close_ts')} AS ACPEDate,
       'P' || buyer_key AS award_id, {iso('signed_ts')} AS CCPSDate, {iso('close_ts')} AS CCPEDate, contract_value AS ContractValue,
       {iso('signed_ts')} AS dateSigned, {iso('auction_start')} AS bid_st_Date, {iso('close_ts')} AS bid_en_Date,
       b.bids, '[null]' AS parties, CAST(year(start_ts) AS BIGINT) AS year
FROM tender_v t LEFT JOIN bid_json b ON b.tender_key = t.tender_key
LEFT JOIN enq_json q ON q.tender_key = t.tender_key""", "tender_v", "bid_json", "enq_json")
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LAST = "CASE WHEN len(l) = {0} THEN replace(l[{0}], '&nbsp;', '') ELSE l[{0}] END"
SQL["harvest_scan"] = f"""
SELECT page_id, CASE WHEN nullif(regexp_extract(html, 'href="([^\n]*),">', 1), '') IS NOT NULL
            THEN concat('{HARVEST_BASE_URL}', regexp_extract(html, 'href="([^\n]*),">', 1)) END AS link,
       replace({_LAST.format(2)}, ' ', '') AS codigo, {_LAST.format(3)} AS entidad_contratante,
       {_LAST.format(4)} AS objeto_del_proceso, {_LAST.format(5)} AS estado_del_proceso,
       {_LAST.format(6)} AS provincia_canton, {_LAST.format(7)} AS presupuesto, {_LAST.format(8)} AS publish_date
FROM (SELECT page_id, html, string_split_regex(
        regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '({_BREAK})$', ''), '{_BREAK}') AS l FROM pages)"""
SQL["drop_all_null"] = f"""
SELECT a.* EXCLUDE (description), b.* EXCLUDE (ocid, NF018)
FROM ({SQL["first_element"]}) a JOIN ({SQL["first_nested"]}) b ON a.ocid = b.ocid"""

# A full tree of 6 levels: the node after six tests, then its leaf; all tests by the model table's rule.
_STEPS = ",\n".join(
    f"s{k + 1} AS (SELECT * EXCLUDE (n), 2 * n + 1 + CASE WHEN coalesce(f[(tree * 7 + n * 3) % 6 + 1] < (tree * 31 + n * 17) % 24 - 3.5, "
    f"(tree + n) % 2 = 0) THEN 0 ELSE 1 END AS n FROM s{k})" for k in range(6))
SQL["score_model_table"] = with_ctes(
    f"""SELECT ocid, CAST(raw > 0.5 AS BIGINT) AS predict, CAST(CAST(raw AS DECIMAL(18, 9)) AS DOUBLE) AS proba, n_of_Tend,
       Pre_No_Respu, awar_perio, enqui_perio, Number_ques, NF039
FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)) AS raw FROM feat JOIN (
  WITH s0 AS (SELECT ocid, [awar_perio, Pre_No_Respu, enqui_perio, Number_ques, NF039, n_of_Tend] AS f, CAST(t.tree AS BIGINT) AS tree,
                     CAST(0 AS BIGINT) AS n FROM feat CROSS JOIN range(100) t(tree)),
  {_STEPS}
  SELECT ocid, sum(CAST((tree * 13 + n * 29) % 201 - 100 AS DOUBLE) / 1000.0::DOUBLE) AS margin FROM s6 GROUP BY ocid) USING (ocid))""", "feat")
_LINEAR = " + ".join(f"{w}::DOUBLE * coalesce({c}, {d})" for c, w, d in zip(
    ("awar_perio", "Pre_No_Respu", "enqui_perio", "Number_ques", "NF039", "n_of_Tend"),
    (0.02, 0.3, -0.05, 0.1, 0.2, -0.4), (10.0, 0.0, 3.0, 0.0, 0.0, 2.0)))
SQL["score_logistic"] = with_ctes(
    f"""SELECT ocid, CAST(raw >= 0.35 AS BIGINT) AS predict, CAST(CAST(raw AS DECIMAL(18, 9)) AS DOUBLE) AS proba, n_of_Tend,
       Pre_No_Respu, awar_perio, enqui_perio, Number_ques, NF039
FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_LINEAR} + 0.5::DOUBLE))) AS raw FROM feat)""", "feat")
SQL["prediction_changes"] = with_ctes("\nUNION ALL ".join(
    f"SELECT a.ocid, '{c}' AS field, CAST(a.{c} AS DOUBLE) AS value_self, CAST(b.{c} AS DOUBLE) AS value_other "
    f"FROM scored a JOIN scored_zero b ON a.ocid = b.ocid WHERE a.{c} IS DISTINCT FROM b.{c}" for c in _DIFF_COLS), "scored", "scored_zero")
DERIVED["harvest_s"] = """
SELECT page_id, CASE page_id % 5
  WHEN 1 THEN concat(fragment, chr(10), 'extra 8', chr(10), 'extra&nbsp;9')
  WHEN 2 THEN concat(fragment, chr(10), 'extra 8&nbsp;')
  WHEN 3 THEN concat(array_to_string(list_slice(string_split(fragment, chr(10)), 1, -2), chr(10)), '&nbsp;')
  WHEN 4 THEN replace(replace(regexp_replace(fragment, '<a[^>]*>', ''), '</a>', ''), chr(10), concat(chr(13), chr(10)))
  ELSE fragment END AS html FROM harvest_v"""
_DEPS["harvest_s"] = ["harvest_v"]
SQL["harvest_shapes"] = with_ctes(SQL["harvest_scan"].replace("FROM pages", "FROM harvest_s").strip(), "harvest_s")
SQL["result_table"] = with_ctes(
    """SELECT ocid, CAST(year(start_ts) AS BIGINT) AS Year, (contract_value - award_value)
       * CASE WHEN year(start_ts) = (SELECT max(year(start_ts)) FROM tender_v) THEN 2 ELSE 1 END AS nf059 FROM tender_v""", "tender_v")
_PROJECTED = f"""SELECT e.*, n.* EXCLUDE (ocid, NF018), n.NF018 AS bids, CAST(1 AS BIGINT) AS tag, CAST(1 AS BIGINT) AS category,
       CAST(1 AS BIGINT) AS parties, q.n_questions AS enquiries, q.n_questions AS enq_desc, q.n_questions AS enq_fechas,
       q.n_questions AS enq_ans_fechas, q.n_questions AS enq_ans
FROM ({SQL["first_element"]}) e JOIN ({SQL["first_nested"]}) n ON n.ocid = e.ocid
LEFT JOIN (SELECT t.ocid, s.n_questions FROM tender_v t JOIN enq_stats s USING (tender_key)) q ON q.ocid = e.ocid"""
SQL["csv_export"] = with_ctes(f"SELECT *, CAST(NULL AS VARCHAR) AS mc_bids FROM ({_PROJECTED})", "tender_v", "enq_stats")
SQL["drop_null_columns"] = with_ctes(f"SELECT * EXCLUDE (description) FROM ({_PROJECTED})", "tender_v", "enq_stats")
SQL["flatten_variant"] = with_ctes(
    f"""SELECT s.*, CAST(1 AS BIGINT) AS tag, CAST(1 AS BIGINT) AS awards, CAST(1 AS BIGINT) AS contracts, CAST(1 AS BIGINT) AS auctions,
       q.n_questions AS tender__enquiries
FROM ({SQL["flatten_struct"]}) s
LEFT JOIN (SELECT t.ocid, s.n_questions FROM tender_v t JOIN enq_stats s USING (tender_key)) q ON q.ocid = s.ocid""", "tender_v", "enq_stats")
