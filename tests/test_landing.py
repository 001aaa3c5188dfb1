"""What the landing shuffles and writes: columns of the tables and compressed text."""
import glob
import gzip
import json
import re

import pytest

from conftest import SF_SMALL
from pliego.plans import deliveries
from pliego.sources import landing as L
from pliego.sources import release_stream as R
from pliego.sources.ocds import read_package_lines, read_packages, read_zipped_packages, releases


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def opened(path: str) -> str:
    with gzip.open(path, "rt", encoding="utf-8") as f:
        return f.read()


def test_landed_lines_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "LINES_PER_FILE", 100)
    out = L.land(spark, SF_SMALL, "lines", out_dir=str(tmp_path / "lines"))
    files = glob.glob(f"{out}/part-*.gz")
    lines = [opened(f).splitlines() for f in files]
    assert max(map(len, lines)) <= 100 and sum(map(len, lines)) == read_package_lines(spark, out).count() > 100
    assert sum(len(open(f, "rb").read()) for f in files) * 3 < sum(len(x.encode()) for part in lines for x in part)


def test_bids_are_dealt_out_as_columns(spark, monkeypatch):
    want = L.release_rows(spark, SF_SMALL)
    assert re.search(r"Exchange hashpartitioning\(tender_key.*REPARTITION_BY_COL", plan(want))
    monkeypatch.setattr(L, "BIDS_PER_TASK", 100)
    many = L.release_rows(spark, SF_SMALL)
    assert re.search(r"Exchange hashpartitioning\(tender_key.*REPARTITION_BY_NUM", plan(many))

    def plain(df):
        out = {}
        for r in df.collect():
            release = json.loads(r.release)
            for stage in release["auctions"][0]["stages"]:
                stage["bids"] = sorted(stage["bids"] or [], key=str)
            release["tender"]["enquiries"] = sorted(release["tender"]["enquiries"] or [], key=str)
            out[r.ocid] = release
        return out
    assert plain(many) == plain(want) and len(plain(want)) > 1000


def test_csv_export_writes_compressed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deliveries, "shared_dir", lambda _, *parts: str(tmp_path.joinpath(*parts)))
    n = deliveries.q_csv_export(spark, SF_SMALL).count()
    texts = [opened(f) for f in glob.glob(f"{tmp_path}/csv-export/part-*.csv.gz")]
    assert sum(t.count("\n") - 1 for t in texts) == n > 0


def test_documents_are_framed_where_the_lines_are_read(spark, tmp_path):
    ids = [f"o-{k}" for k in range(1003)]
    lines = spark.createDataFrame([('{"releases": [{"ocid": "%s"}]}' % i,) for i in ids], "value string").coalesce(1)
    lines.write.text(str(tmp_path / "lines"), compression="gzip")
    out = L.documents_from_lines(spark, str(tmp_path / "lines"), str(tmp_path / "documents"), 250)
    found = [[r["ocid"] for r in json.loads(opened(f))["releases"]] for f in sorted(glob.glob(f"{out}/part-*.gz"))]
    assert [len(f) for f in found] == [250, 250, 250, 250, 3] and sum(found, []) == ids  # in order: nothing was dealt anew
    zips = L.zips_from_documents(spark, out, str(tmp_path / "zips"))
    assert sorted(r.ocid for r in releases(read_zipped_packages(spark, zips)).select("ocid").collect()) == sorted(ids)
    assert releases(read_packages(spark, out)).count() == len(ids)


def test_no_lines_no_documents(spark, tmp_path):
    spark.createDataFrame([], "value string").write.text(str(tmp_path / "lines"))
    out = L.documents_from_lines(spark, str(tmp_path / "lines"), str(tmp_path / "documents"))
    assert R.read_release_stream(spark, out, "document", 3).count() == 0
    assert R.read_release_stream(spark, L.zips_from_documents(spark, out, str(tmp_path / "zips")), "zip", 3).count() == 0


def packages(folder, counts, zipped=()):
    for k, n in enumerate(counts):
        data = json.dumps({"releases": [{"ocid": f"{k}-{i}"} for i in range(n)]}).encode()
        name = folder / f"f{k:02d}.json{'.gz' if k in zipped else ''}"
        name.write_bytes(gzip.compress(data) if k in zipped else data)


def test_many_even_files_are_shared_without_a_shuffle(spark, tmp_path):
    packages(tmp_path, [20] * 30)
    df = R.read_release_stream(spark, str(tmp_path), "document", 4)
    assert "Exchange" not in plan(df) and df.rdd.getNumPartitions() == 4
    assert sorted(r.ocid for r in df.collect()) == sorted(f"{k}-{i}" for k in range(30) for i in range(20))


@pytest.mark.parametrize("counts", [[20] * 3, [5000] + [1] * 29])
def test_few_or_uneven_files_are_spread_by_release(spark, tmp_path, counts):
    packages(tmp_path, counts)
    df = R.read_release_stream(spark, str(tmp_path), "document", 4)
    assert "Exchange" in plan(df) and df.rdd.getNumPartitions() == 4 and df.count() == sum(counts)


def test_compressed_documents(spark, tmp_path):
    packages(tmp_path, [3, 4], zipped=(1,))
    assert R.read_release_stream(spark, str(tmp_path)).count() == 7
    whole = (tmp_path / "f01.json.gz").read_bytes()
    (tmp_path / "f01.json.gz").write_bytes(whole[:-20])
    with pytest.raises(Exception, match="f01.json.gz"):
        R.read_release_stream(spark, str(tmp_path)).count()


def test_parquet_landing_sorts_small_tasks(spark, tmp_path, monkeypatch):
    """A task of the parquet landing, which sorts its rows, gets few files; the caller's session keeps its settings."""
    monkeypatch.setattr(L, "LINES_PER_FILE", 100)
    monkeypatch.setattr(L, "TASK_BYTES", "1k")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = L.land(spark, SF_SMALL, "lines", out_dir=str(tmp_path / "lines"))
    out = L.to_parquet(spark, lines, str(tmp_path / "parquet"))
    tasks = {re.search(r"part-(\d+)", f)[1] for f in glob.glob(f"{out}/*/part-*.parquet")}
    assert len(tasks) == len(glob.glob(f"{lines}/part-*.gz")) > 8
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert spark.read.parquet(out).count() == read_package_lines(spark, lines).count()
