"""Whole documents read as a stream: the same releases, bounded memory."""
import io
import json
import subprocess
import sys
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from pliego.sources import release_stream as R
from pliego.sources.landing import land
from pliego.sources.ocds import read_packages, releases

scalars = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


def texts(document: str | bytes, chunk: int = R.CHUNK) -> list[str]:
    data = document.encode() if isinstance(document, str) else document
    old, R.CHUNK = R.CHUNK, chunk
    try:
        return list(R.release_texts(R.decoded(io.BytesIO(data))))
    finally:
        R.CHUNK = old


@settings(max_examples=150, deadline=None)
@given(before=st.dictionaries(st.text(max_size=6).filter(lambda k: k != "releases"), values, max_size=3), found=st.lists(values, max_size=5),
       after=st.dictionaries(st.text(min_size=9, max_size=12), values, max_size=2), chunk=st.integers(1, 40), indent=st.sampled_from([None, 1, 3]),
       plain=st.booleans())
def test_elements_equal_a_whole_parse(before, found, after, chunk, indent, plain):
    document = json.dumps({**before, "releases": found, **after}, indent=indent, ensure_ascii=plain)
    assert [json.loads(t) for t in texts(document, chunk)] == found


@pytest.mark.parametrize("document", ["{}", '{"releases": null}', ' {"a": [1, {"releases": [2]}], "b": "releases"} ', '﻿{"releases": []}'])
def test_documents_without_releases(document):
    assert texts(document) == texts(document, 1) == []


@pytest.mark.parametrize("document", ["", "[]", "nonsense", '{"releases": 5}', '{"releases": [{"a": 1}', '{"releases": [{"a": 1} {}]}',
                                      '{"releases": [{"a": tru}]}', '{"releases": ["open]}', '{5: 1}', b'{"releases": ["\xff"]}'])
def test_broken_documents_are_errors(document):
    for chunk in (1, 7, R.CHUNK):
        with pytest.raises(ValueError):
            texts(document, chunk)


def test_an_error_early_on_stops_the_reading():
    """A fault far from the end does not pull in the rest of the document."""
    read = io.BytesIO(b'{"releases": [{"a": ?' + b"x" * 50_000_000)
    with pytest.raises(ValueError):
        list(R.release_texts(R.decoded(read)))
    assert read.tell() < 1_000_000


PEAK = """
import resource, sys, zipfile
sys.path.insert(0, {repo!r})
from pliego.sources.release_stream import decoded, release_texts
n = 0
with zipfile.ZipFile({path!r}) as z, z.open(z.namelist()[0]) as member:
    for text in release_texts(decoded(member)):
        n += 1
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


def test_peak_memory_does_not_grow_with_the_document(tmp_path):
    """4 MB against 120 MB of text: the peak of the process stays within 4 MB."""
    import os
    peaks = []
    for n in (2_000, 60_000):
        path = tmp_path / f"{n}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("p.json", "w") as f:
            f.write(b'{"releases": [')
            for k in range(n):
                f.write((", " if k else "").encode() + json.dumps({"ocid": f"o-{k}", "text": f"{k} " * 300}).encode())
            f.write(b"]}")
        code = PEAK.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), path=str(path))
        count, peak = subprocess.run([sys.executable, "-c", code], capture_output=True, check=True).stdout.split()
        assert int(count) == n
        peaks.append(int(peak) / 1024)
    assert peaks[1] < peaks[0] + 4, peaks


def test_streams_hold_the_releases_of_the_packages(spark, tmp_path):
    for layout in ("package", "zip"):
        out = land(spark, SF_SMALL, layout, out_dir=str(tmp_path / layout), releases_per_file=400)
        docs = out if layout == "package" else out + "_documents"
        want = releases(read_packages(spark, docs))
        got = R.read_release_stream(spark, out, "document" if layout == "package" else "zip", 7)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.rdd.getNumPartitions() == 7


def test_files_share_tasks_and_large_ones_do_not(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"f{k}.json").write_text(json.dumps({"releases": [{"ocid": f"{k}-{i}"} for i in range(k)]}))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".f0.json.crc").write_text("x")
    df = R.read_release_texts(spark, str(tmp_path))
    assert df.count() == 15 and df.rdd.getNumPartitions() == 1
    reader = R._Reader({"path": "file:" + str(tmp_path)})
    monkeypatch.setattr(R, "TASK_BYTES", 40)
    assert [p for part in reader.partitions() for p in part.paths] == [str(tmp_path / f"f{k}.json") for k in range(6)]
    assert len(reader.partitions()) > 3


def test_a_broken_file_is_named(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"releases": [{"ocid": "a"}]}')
    (tmp_path / "broken.json").write_text('{"releases": [{"ocid": "a"')
    with pytest.raises(Exception, match="broken.json"):
        R.read_release_stream(spark, str(tmp_path)).count()
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="bad.zip"):
        R.read_release_stream(spark, str(tmp_path / "z"), "zip").count()
    with pytest.raises(Exception, match="(?i)not.?found|no such"):
        R.read_release_stream(spark, str(tmp_path / "nowhere")).count()
