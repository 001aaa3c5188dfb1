"""Anchor expansion against the plain patterns of the base kinds."""
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pliego.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AUTO = pii.anchors()


def luhn(ds):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(ds))) % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                spans.append(m.span())
        out[kind] = spans
    return out


def base(text):
    return {k: v for k, v in pii.find_spans(text, AUTO).items() if k in PATTERNS}


def test_examples():
    text = ("x@y.zz a@b a@b..c q.r+s%t@u-v.w.x@y.z 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 4465758382889437 "
            "4465 7583-8288 9437  +1 (743) 555-3824, +49.() +1 2 mail 4465758382889437 4465758382889437 é@é.com "
            "٣.1.2.3.4 +12345678 ++1234567890(")
    assert base(text) == plain(text)
    assert base("x 4465758382889437; 4465 7583-8288 9437 x")["card"] == [(2, 18), (20, 39)]
    assert not base("4465758382889437 4465758382889437")["card"]  # one run of 32 digits
    assert len(base(text)["email"]) == 2


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("0123456789.. --++@@ab%(é\n"), max_size=60))
def test_any_text(text):
    assert base(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4465758382889437", "4465 7583 8288 9437", "1.2.3.4", "@", "a.b@c.de", "+1 743 555-3824",
                                 " ", ".", "-", "x", "255", "http://a.b/c@d.ef", "IBAN DE89 3704 0044 0532 0130 00"]), max_size=12))
def test_mixed_pieces(parts):
    text = "".join(parts)
    assert base(text) == plain(text)
    for kind, spans in pii.find_spans(text, AUTO).items():
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])), kind


def test_added_kinds():
    t = "see https://a.example.com/x?y=1, IBAN: DE89 3704 0044 0532 0130 00 ok; account no. 12345678 by @someone_1 http://x"
    got = {k: [t[s:e] for s, e in v] for k, v in pii.find_spans(t, AUTO).items()}
    assert got["url"] == ["https://a.example.com/x?y=1"]
    assert got["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert got["handle"] == ["@someone_1"]
    assert pii.redact(t, AUTO) == "see <URL>, IBAN: <ACCOUNT> ok; account no. <ACCOUNT> by <HANDLE> http://x"
    assert pii.redact("mail a@b.cd", AUTO) == "mail <EMAIL>" and pii.redact(None, AUTO) is None


def test_whole_table(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)


def test_odd_rows(spark):
    long = "word " * 50000 + "a@b.cd"
    rows = [(1, None, 5), (2, "", 6), (3, long, 7), (3, long, 7), (None, "1.2.3.4", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in pii.pii_digest(df).collect()))
    assert got == [(0, 0, 1, "ip:0:7"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:250000:250006"), (3, 1, 0, "email:250000:250006")]
    assert pii.redact_column(df).columns == df.columns
    assert sorted(r.text or "" for r in pii.redact_column(df).collect())[:3] == ["", "", "<IP>"]
    assert pii.pii_digest(df.limit(0)).count() == 0
    assert [len(r.pii_spans) for r in pii.pii_spans(df).orderBy("doc_id").collect()] == [1, 0, 0, 1, 1]


def test_time_grows_with_the_text_only():
    """A megabyte of any chain of anchors takes no longer than eight times an eighth of it, some milliseconds aside."""
    import time
    chains = ["http://", "http://a..", "https://x.y/", "ftp://@", "@", "a@", "a@b.", "+", "+1 ", "+1(", "1", "1.", "1 ", "1-2.", "iban ", "account:",
              "konto number 1", "ssn-1 ", "http://" + "." * 50, "@@a_b", "IBAN DE89 ", "compte" + " " * 99]

    def took(text):
        t = time.process_time()
        pii.find_spans(text, AUTO)
        return time.process_time() - t
    for c in chains:
        small, large = c * (125_000 // len(c)), c * (1_000_000 // len(c))
        t = took(large)
        assert t < 16 * took(small) + .1 and t < 8, c
    for tail in ("http://" * 20_000 + "." * 500_000, "x" * 10 ** 6 + "@" * 10, "account:" + "account" * 100_000, "+" + "1 " * 500_000):
        assert took(tail) < 8, tail[:20]


def test_schemes_within_one_run():
    """Every scheme of a run is tried until one has a host; closing punctuation stays out."""
    text = "http://http://ftp://a.b/c)., http://x..y/http://q.r?s. http://@:http://.. https://u@v.w:80/http://z.z"
    assert [text[s:e] for s, e in pii.find_spans(text, AUTO)["url"]] == ["ftp://a.b/c", "http://q.r?s", "https://u@v.w:80/http://z.z"]
