"""Harvested rows: parsing, first window match, join."""
import pytest

from pliego.operators.harvest import first_window_match, harvest_join, parse_fragments


def frag(code, date, status="Desierta", extra=0):
    tail = "".join(f"\nX{i}" for i in range(extra))
    return (f'<td>\n<a href="info.cpe?id=1,">{code}</a>\nENT\nOBJ\n{status}\nPROV\n100\n{date}{tail}&nbsp;')


def test_parse_eight_fields(spark):
    df = spark.createDataFrame([(1, frag("SIE-1 -2022", "2022-03-04"))], "page_id long, fragment string")
    r = parse_fragments(df).first()
    assert r.codigo == "SIE-1-2022" and r.publish_date == "2022-03-04"
    assert r.estado_del_proceso == "Desierta" and r.link.endswith("info.cpe?id=1")


def test_first_half_year_wins(spark):
    h = spark.createDataFrame([
        (1, frag("C-1", "2022-09-01")), (2, frag("C-1", "2022-02-01")), (3, frag("C-1", "2022-05-01")),
        (4, frag("C-2", "2022-11-01")), (5, frag("C-3", "2021-01-01"))], "page_id long, fragment string")
    codes = spark.createDataFrame([("C-1", 2022), ("C-2", 2022), ("C-3", 2022), ("C-1", 2022)],
                                  "codigo string, Year long")
    rows = {r.codigo: r for r in first_window_match(codes, parse_fragments(h)).collect()}
    assert set(rows) == {"C-1", "C-2"}
    assert rows["C-1"].page_id == 2 and str(rows["C-1"].window_end) == "2022-06-30"
    assert rows["C-2"].page_id == 4 and str(rows["C-2"].window_start) == "2022-07-01"


def test_a_repeated_code_counts_with_its_first_row(spark):
    h = parse_fragments(spark.createDataFrame([(1, frag("C-1", "2022-01-02")), (2, frag("C-1", "2022-01-01")), (3, frag("C-1", "n/a"))],
                                              "page_id long, fragment string"))
    t = spark.createDataFrame([("o1", "C-1")], "ocid string, codigo string")
    assert [r.page_id for r in harvest_join(t, h).collect()] == [2]
    with pytest.raises(ValueError):
        harvest_join(t, h, require_unique=True)
    assert harvest_join(t, h.where("page_id = 1"), require_unique=True).count() == 1


def test_lines_and_links_as_in_python(spark):
    from pliego.functions.text import first_link, text_lines
    texts = ["a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b\u2028c\u2029d", "a\r\nb\rc\n", "\n", "a\n\n", "x"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(text_lines("t")).collect()] == [x.splitlines() for x in texts]
    df = spark.createDataFrame([('<a href="x\ry\u2028,">',), ('<a href="x\ny,">',)], "t string")
    assert [r[0] for r in df.select(first_link("t", "b/")).collect()] == ["b/x\ry\u2028", None]


def test_fragment_files_of_all_shapes(spark, tmp_path):
    """7, 9 and 10 fields, no link, CR LF: missing fields are NULL, further ones are left out."""
    from pliego.sources.fragments import read_fragment_files, read_fragment_table
    base = frag("C-1", "2022-01-02").split("\n")
    shapes = {"a": base[:7], "b": [*base, "x"], "c": [*base, "x", "y"], "d": [base[0], "C-9", *base[2:]]}
    for name, lines in shapes.items():
        with open(tmp_path / f"{name}.html", "w", newline="") as f:
            f.write(("\r\n" if name == "b" else "\n").join(lines))
    df = read_fragment_files(spark, str(tmp_path))
    got = {r.file[-6]: r for r in parse_fragments(df).collect()}
    assert [got[k].codigo for k in "abcd"] == ["C-1", "C-1", "C-1", "C-9"]
    assert got["a"].publish_date is None and got["b"].publish_date == "2022-01-02&nbsp;" and got["d"].link is None
    df.write.parquet(str(tmp_path / "t"))
    assert read_fragment_table(spark, str(tmp_path / "t"), "fragment", ["file"]).count() == 4
