"""Plan shape: pushdown, no shuffle in the nested flow, no Python in native paths."""
from conftest import SF_SMALL

import __spark_entry__ as E
import contextlib
import io

from pliego.plans.packages import INDICATOR_OUTPUT, indicators_from_packages
from pliego.sources.landing import landed
from pliego.sources.ocds import read_package_parquet


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_method_filter_reaches_the_scan(spark):
    df = E.queries()["filter_method"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_nested_flow_has_no_shuffle_and_prunes_columns(spark):
    pk = read_package_parquet(spark, landed(spark, SF_SMALL, "parquet"))
    df = indicators_from_packages(pk, "1-URGENT").select(*INDICATOR_OUTPUT)
    assert "Exchange" not in executed(df)
    read_schema = [ln for ln in formatted(df).splitlines() if ln.startswith("ReadSchema")][0]
    for unused in ("parties:", "planning:", "tag:", "suppliers:", "description:"):
        assert unused not in read_schema, unused
    assert "PartitionFilters: [isnotnull(first_method" in formatted(df)


def test_native_paths_stay_in_the_jvm(spark):
    for name in ("score_trees", "topic_documents", "red_flags_full", "harvest_parse"):
        plan = executed(E.queries()[name](spark, SF_SMALL))
        assert "Python" not in plan and "ArrowEval" not in plan, name


def test_python_model_path_is_arrow_batched(spark):
    plan = executed(E.queries()["score_udf"](spark, SF_SMALL))
    assert "MapInPandas" in plan or "MapInArrow" in plan
