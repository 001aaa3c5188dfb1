"""FL-2a / FL-2b: a lookup before the method filter finds any tender; after
the filter and scoring, an id of another method gives an empty result."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pliego.plans.flows import indicator_flow, scored_views
from pliego.plans.views import TEST_METHOD, bids_view, enquiry_view_and_hot, tender_view


def test_lookup_before_and_after_method_filter(spark):
    t = tender_view(spark, SF_SMALL)
    other = t.where(F.col("method") != TEST_METHOD).select("ocid").first()[0]
    kept = t.where(F.col("method") == TEST_METHOD).select("ocid").first()[0]
    e, hot = enquiry_view_and_hot(spark, SF_SMALL)
    found = indicator_flow(t.where(F.col("ocid") == other), e, bids_view(spark, SF_SMALL), None,
                           enquiry_hot=hot)
    assert [r.ocid for r in found.collect()] == [other]
    assert scored_views(spark, SF_SMALL, ocid=other).count() == 0
    assert [r.ocid for r in scored_views(spark, SF_SMALL, ocid=kept).collect()] == [kept]
    assert scored_views(spark, SF_SMALL, ocid="ocds-5wno2w-unknown").count() == 0


def test_lookup_queries_find_something(spark):
    import __spark_entry__ as E
    assert E.queries()["lookup_any"](spark, SF_SMALL).count() == E.queries()["lookup_scored"](spark, SF_SMALL).count() == 1


def test_status_with_every_page_twice(spark, tmp_path):
    """A code harvested twice changes no score and gives no second row."""
    import os
    import shutil

    import __spark_entry__ as E
    for name in os.listdir(SF_SMALL):
        if name != "pages.parquet":
            shutil.copy(f"{SF_SMALL}/{name}", tmp_path)
    p = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    p.union(p).write.parquet(str(tmp_path / "pages.parquet"))
    for q in ("score_status", "highlight_flags", "display_table", "harvest_join"):
        once = E.queries()[q](spark, SF_SMALL).collect()
        assert sorted(map(str, E.queries()[q](spark, str(tmp_path)).collect())) == sorted(map(str, once)) and once
