"""Template windows against a plain per-document version."""
import re

import pytest

from pliego.llm import decontaminate as D

ITEM = ("A farmer called Maria sells 12 apples for 3 dollars at the market and walks 5 km home. "
        "How many apples did Maria sell if each of the 12 apples weighs 200 g?")


def plain_tokens(text, inside=False):
    out, start, prev = [], not inside, None
    for w in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]", text or ""):
        if w in ".!?\n":
            start = True
            prev = None
            continue
        low = w.lower()
        if w[0].isdigit():
            kind = D.NUMBER
        elif prev == D.NUMBER and low in D.UNITS:
            kind = D.UNIT
        elif len(w) > 1 and w[0].isupper() and w[1:].islower() and not start:
            kind = D.NAME
        else:
            kind = D.LITERAL
        out.append((kind, low))
        start, prev = False, kind
    return out


def plain(docs, items):
    """{(doc_id, item_id): (windows that count, windows, changed)}"""
    def grams(ts, k):
        return [tuple(t if t[0] == D.LITERAL else t[0] for t in ts[i:i + k]) for i in range(len(ts) - k + 1)]

    def slots(ts, i, k):
        return [t[1] for t in ts[i:i + k] if t[0] != D.LITERAL]
    out = {}
    for d, text in docs:
        dt = plain_tokens(text)
        for m, item in items:
            it = plain_tokens(item)
            k = min(D.WINDOW, len(it))
            if not k:
                continue
            firsts = [it, plain_tokens(item, True)]
            hits = set()
            for n, ts in enumerate(firsts):
                gs = grams(ts, k)[:1] if n else grams(ts, k)
                for j, g in enumerate(grams(dt, k)):
                    hits |= {(j - i, i, tuple(slots(ts, i, k)), tuple(slots(dt, j, k))) for i, h in enumerate(gs) if g == h}
            to = {}
            for shift, _, a, b in hits:
                for x, y in zip(a, b):
                    to.setdefault((shift, x), set()).add(y)
            good = [h for h in hits if all(len(to[h[0], x]) == 1 for x in h[2])]
            at = {h[1] for h in good}
            if len(at) >= D.SIMILARITY * (len(it) - k + 1):
                same = {h[1] for h in good if h[2] == h[3]}
                out[d, m] = (len(at), len(it) - k + 1, len(at - same))
    return out


def found(spark, docs, items):
    rows = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.n_changed) for r in rows}


def test_reparameterised_question(spark):
    other = ITEM.replace("Maria", "Pedro").replace("12", "40").replace("200 g", "3 kg").replace("5 km", "9 miles")
    broken = ITEM.replace("12", "40", 1).replace("Maria sell", "Pedro sell")  # 12 -> 40 and 12, Maria -> Maria and Pedro
    docs = [(1, "Some words before " + ITEM + " and after."), (2, other), (3, broken), (4, ITEM.lower()), (5, "nothing here"),
            (6, ITEM[:90]), (7, other.replace("9 miles", "9 spoons"))]
    items = [(10, ITEM), (11, ITEM), (12, None), (13, ""), (14, "two words"), (15, "?!")]
    got, want = found(spark, docs, items), plain(docs, [items[0], items[4]])
    assert got == want
    assert got[1, 10][0] == got[1, 10][1] and got[1, 10][2] == 0
    assert got[2, 10][2] > 5 and (3, 10) not in got and (5, 10) not in got and (6, 10) not in got


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    from pliego.llm.queries import QUERIES
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.n_changed) for r in QUERIES["op5_decontamination"](spark, sf_dir).collect()}
    assert got == plain(docs, items) and got


@pytest.mark.parametrize("cache", [5, D.CACHE])
def test_cache_limit_changes_nothing(spark, monkeypatch, cache):
    monkeypatch.setattr(D, "CACHE", cache)
    docs = [(i, f"Word {i} then. " + ITEM) for i in range(3)]
    assert len(found(spark, docs, [(1, ITEM)])) == 3


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, ITEM, 7), (3, ITEM, 7), (None, ITEM, 8), (4, "word " * 100000 + ITEM, 9), (5, "clean text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM, "x")], "item_id long, text string, doc_id string")
    got = D.contamination(docs, bench)
    assert sorted((r.doc_id or 0, r.item_id) for r in got.collect()) == [(0, 1), (3, 1), (4, 1)]
    left = D.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert D.decontaminated(docs.limit(0), bench).count() == 0
    assert D.decontaminated(docs, bench.limit(0)).count() == len(rows)


def test_copies_in_other_letter_case(spark):
    lines = ITEM.replace("called Maria", "called\nMaria").replace("did Maria", "did\nMaria")
    texts = [ITEM, ITEM.lower(), ITEM.upper(), lines, "So: " + ITEM.lower(), ITEM.replace("Maria", "Pedro").upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(docs, items, any_case=True).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert all(r.n_windows == r.item_windows and not r.n_changed for r in got.values())
    assert sorted(r.doc_id for r in D.decontaminated(docs, items).collect()) == [5]
    back = spark.createDataFrame([(1, ITEM.lower())], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contamination(docs, back, any_case=True).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("any_case", [False, True])
def test_short_and_numeric_items(spark, any_case):
    bare = "Sum: 12 + 7 + 5 + 3 + 9 + 4 = 40"
    sums = "Please work out 12 + 7 * 3 - 4 / 2 + 9 and give the result of it as x"
    items = [(1, "12 + 7 = 19"), (2, "We met Maria"), (3, bare), (4, sums), (5, "1 2 3 4 5 6 7 8")]
    docs = [(1, "There are 3, 4, 5, 8, 9, 10 and 11."), (2, "He says 12 + 7 = 19 here"), (3, "we met maria."), (4, "Then we met Pedro."),
            (5, "I add " + bare.lower()), (6, "A sum 4 8 9 6 7 5 3 2"), (7, sums.replace("12", "31").replace("9", "6")), (8, "is 1 2 3 4 5 6 7 8")]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), any_case=any_case)
    assert {(r.doc_id, r.item_id): (r.n_windows == r.item_windows, r.n_changed > 0) for r in got.collect()} == {
        (2, 1): (True, False), (3, 2): (True, False), (5, 3): (True, False), (7, 4): (True, True), (8, 5): (True, False)}
