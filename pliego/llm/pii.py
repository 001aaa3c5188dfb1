"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``+``, digits,
schemes and identifier cues.  A deterministic local parser expands each anchor
to both sides, as far as its kind's alphabet reaches, and validates what it got:

=========  =================================  ===========================================
kind       anchor                             check
=========  =================================  ===========================================
email      ``@``                              local part, dotted domain
ip         digit before a dot                 four numbers of at most 255
card       digit                              16 to 19 digits, Luhn
phone      ``+`` before a digit               8 to 15 digits
url        ``http://`` ``https://`` ``ftp://``  host with a dot; closing punctuation left out
account    ``IBAN`` ``account`` ... cue       IBAN checksum, or 6 to 34 letters and digits
                                              with at least 6 digits after the cue
handle     ``@`` not taken by an email        3 to 30 word characters after it, no word before
=========  =================================  ===========================================

The first four kinds are leftmost and non-overlapping within their kind; a
match that fails its check is dropped and scanning goes on behind it.
Positions are code points, ends exclusive.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "handle")
# Alphabets of the kinds, schemes and cues.
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
IN_CARD = frozenset(" -")
IN_PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\r\x0b\x0c<>\"'`")
URL_TAIL = ".,;:!?)]}"
WORD = LETTERS | DIGITS | frozenset("_")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn")
AFTER_CUE = frozenset(" :#.=\t")
AFTER_CUE_WORDS = ("number", "no", "nr", "num")

Span = tuple[int, int]


def anchors() -> ahocorasick.Automaton:
    """Automaton of all anchors; a value is the anchor's sort and length."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in DIGITS:
        a.add_word(d, ("0", 1))
    for s in SCHEMES:
        for form in {s, s.upper(), s.capitalize()}:
            a.add_word(form, ("s", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("c", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if n % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def run_right(text: str, i: int, alphabet: frozenset[str]) -> int:
    n = len(text)
    while i < n and text[i] in alphabet:
        i += 1
    return i


def email(text: str, at: int, floor: int) -> Span | None:
    """Expands an at-sign; ``floor`` is the end of the previous email."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = False
    while end < len(text) and text[end] == ".":
        after = run_right(text, end + 1, LABEL)
        if after == end + 1:
            break
        dotted, end = True, after
    return (start, end) if dotted else None


def numbers(text: str, start: int) -> tuple[list[Span], int]:
    """The dotted numbers from the digit at ``start``: spans of all groups of four, and the end."""
    parts, i = [], start
    while True:
        end = run_right(text, i, DIGITS)
        parts.append((i, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    quads = [parts[k:k + 4] for k in range(0, len(parts) - 3, 4)]
    return [(q[0][0], q[3][1]) for q in quads if all(octet(text, p) for p in q)], parts[-1][1]


def octet(text: str, part: Span) -> bool:
    s = text[part[0]:part[1]].lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def card(text: str, start: int) -> tuple[Span | None, int]:
    """The run of digits with single spaces or hyphens between, from the digit at ``start``."""
    n, i = len(text), start + 1
    while i < n:
        if text[i] in DIGITS:
            i += 1
        elif text[i] in IN_CARD and i + 1 < n and text[i + 1] in DIGITS:
            i += 2
        else:
            break
    if i - start >= 16:
        digits = text[start:i].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            return (start, i), i
    return None, i


def phone(text: str, plus: int) -> Span | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = run_right(text, plus + 2, IN_PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end - plus < 4:  # a digit, at least one more character, a digit
        return None
    n = sum(c in DIGITS for c in text[plus:end])
    return (plus, end) if 8 <= n <= 15 else None


def url_run(text: str, i: int) -> Span:
    """(end, end without closing punctuation) of the run of characters of a URL from ``i`` on."""
    n, start = len(text), i
    while i < n and text[i] not in URL_END:
        i += 1
    kept = i
    while kept > start and text[kept - 1] in URL_TAIL:
        kept -= 1
    return i, kept


def url(text: str, start: int, after: int, kept: int) -> Span | None:
    """The URL of a scheme at ``start..after`` in a run that ends at ``kept``."""
    end = max(after, kept)
    slash = text.find("/", after, end)
    host = text[after:slash if slash >= 0 else end].rsplit("@", 1)[-1].split(":", 1)[0].split("?", 1)[0]
    ok = "." in host.strip(".") and all(label for label in host.split("."))
    return (start, end) if ok else None


def iban(s: str) -> bool:
    if not (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account(text: str, start: int, end: int) -> Span | None:
    """The identifier behind a cue at ``start..end``: an IBAN, or one with at least 6 digits."""
    if start and text[start - 1] in WORD:
        return None
    i = run_right(text, end, AFTER_CUE)
    for w in AFTER_CUE_WORDS:
        if text[i:i + len(w)].lower() == w and not text[i + len(w):i + len(w) + 1].isalnum():
            i = run_right(text, i + len(w), AFTER_CUE)
            break
    if i == end:
        return None
    # groups of letters and digits, joined by single spaces or hyphens, that hold a digit
    j, last = i, i
    while True:
        j = run_right(text, last, LETTERS | DIGITS)
        if j == last or j - i > 42 or not any(c in DIGITS for c in text[last:j]):
            j = last - 1 if last > i else i
            break
        if j + 1 < len(text) and text[j] in IN_CARD and text[j + 1] in WORD:
            last = j + 1
        else:
            break
    body = text[i:j].replace(" ", "").replace("-", "").upper()
    ok = iban(body) or 6 <= len(body) <= 34 and sum(c in DIGITS for c in body) >= 6
    return (i, j) if ok else None


def handle(text: str, at: int) -> Span | None:
    end = run_right(text, at + 1, WORD)
    if not 3 <= end - at - 1 <= 30 or at and (text[at - 1] in LOCAL or text[at - 1] == "@"):
        return None
    return (at, end)


def find_spans(text: str | None, automaton: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """All spans by kind, each list ascending."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return found
    ends = dict.fromkeys(KINDS, 0)  # where the scan of a kind stands
    ats = []
    run, kept = 0, 0  # where the last URL's run of characters ends: schemes in one run share it

    def take(kind: str, span: Span | None) -> None:
        if span:
            found[kind].append(span)
            ends[kind] = span[1]

    for last, (sort, size) in automaton.iter(text):
        at = last - size + 1
        if sort == "0":
            if at >= ends["card"]:
                span, ends["card"] = card(text, at)
                if span:
                    found["card"].append(span)
            if at >= ends["ip"]:
                spans, ends["ip"] = numbers(text, at)
                found["ip"] += spans
        elif sort == "@":
            take("email", email(text, at, ends["email"]))
            ats.append(at)
        elif sort == "+":
            if at >= ends["phone"]:
                take("phone", phone(text, at))
        elif sort == "s":
            if at >= ends["url"]:
                if last + 1 > run:
                    run, kept = url_run(text, last + 1)
                take("url", url(text, at, last + 1, kept))
        elif at >= ends["account"]:
            take("account", account(text, at, last + 1))
    taken = iter([*found["email"], (len(text), len(text) + 1)])
    mail = next(taken)
    for at in ats:
        while mail[1] <= at:
            mail = next(taken)
        if not mail[0] <= at < mail[1] and at >= ends["handle"]:
            take("handle", handle(text, at))
    return found


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))


def pii_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``pii_spans``: array of (kind, start, end), by kind, then start.  Null text: none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make() -> Callable:
        auto = anchors()

        def each(texts):
            rows = []
            for t in texts:
                spans = find_spans(t, auto)
                rows.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in spans[k]])
            return [pa.array(rows, kind)]
        return each
    return add_columns(df, text_col, T.StructType([T.StructField("pii_spans", SPANS)]), make)


def pii_digest(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with counts of the base kinds, the digest of the base spans and the list of all spans."""
    new = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
                        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def make() -> Callable:
        auto = anchors()

        def each(texts):
            counts, digests, lists = [[] for _ in BASE], [], []
            for t in texts:
                spans = find_spans(t, auto)
                for c, k in zip(counts, BASE):
                    c.append(len(spans[k]))
                digests.append(hashlib.sha256(listed(spans, BASE).encode()).hexdigest())
                lists.append(listed(spans, KINDS))
            return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())]
        return each
    return add_columns(df, text_col, new, make)


def redact(text: str | None, automaton: ahocorasick.Automaton) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the
    leftmost, then the longest, names the placeholder, which covers their union."""
    if not text:
        return text
    spans = find_spans(text, automaton)
    rows = sorted((s, -e, k) for k in KINDS for s, e in spans[k])
    if not rows:
        return text
    out, pos, n = [], 0, 0
    while n < len(rows):
        start, end, kind = rows[n][0], -rows[n][1], rows[n][2]
        n += 1
        while n < len(rows) and rows[n][0] < end:
            end = max(end, -rows[n][1])
            n += 1
        out += [text[pos:start], f"<{kind.upper()}>"]
        pos = end
    return "".join([*out, text[pos:]])


def redact_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the personal data of its text column replaced; nulls and other columns stay."""
    at, names = df.columns.index(text_col), list(df.columns)

    def run(batches):
        auto = anchors()
        for b in slices(batches):
            texts = pa.array([redact(t, auto) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=names)
    return df.mapInArrow(run, df.schema)
