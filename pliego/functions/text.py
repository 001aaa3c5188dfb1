"""Text rules (FL-3a/b, ST-1 … ST-7) as native Column expressions.

Everything here runs inside whole-stage codegen: regex functions are Spark's
built-ins (Java regex), no Python UDF.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import as_col

# --- fixed values: must equal the source system's for equal results ---------
# Procurement method kept by both pipelines.
METHOD_REVERSE_AUCTION = "Subasta Inversa Electrónica"
# Publisher prefix of every OCDS id; the process code follows it.
OCID_PREFIX = "ocds-5wno2w-"
# Wide "convalidation / no questions" pattern (scoring pipeline), verbatim;
# several alternatives end in a space on purpose.
RE_WIDE = (
    "Convalidación |convalidación |CONVALIDA |CONVALIDAR |Convalidacion |"
    "convalidacion |CONVALIDACION |NO se presentaron preguntas|convalidación,|"
    "NO EXISTE CONVALIDACION|CONVALIDAR|CONVALIDACION|convalidación|convalidar|"
    "CONVALIDACIÓN"
)
# Narrow pattern (indicator pipeline).  The source text also has the
# alternative "CONVALIDAR" followed by a run of spaces (a line-continuation
# artefact); "CONVALIDA" already covers it, so it is left out.
RE_NARROW = (
    "Convalidación|convalidación|CONVALIDA|Convalidacion|convalidacion|CONVALIDACION"
)
# Base URL put in front of the first link of a harvested row.
HARVEST_BASE_URL = "https://www.compraspublicas.gob.ec/ProcesoContratacion/compras/PC/"
# Harvested row fields, in page order, with the labels the search page uses.
HARVEST_LABELS = [
    "Link", "Codigo", "Entidad Contratante", "Objeto del Proceso",
    "Estado del Proceso", "Provincia/Cantón", "Presupuesto", "date",
]
# The same fields as DataFrame column names (no spaces or slashes).
HARVEST_COLUMNS = [
    "link", "codigo", "entidad_contratante", "objeto_del_proceso",
    "estado_del_proceso", "provincia_canton", "presupuesto", "publish_date",
]
# Status text of a deserted process on the search page.
STATUS_DESERTED = "Desierta"
# ---------------------------------------------------------------------------

_TAG = "<[^>]+>"
# line ends of Python's str.splitlines
_LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


# Literal prefilters: every alternative of the pattern contains one of these
# substrings, so text without any of them cannot match.  A substring test is
# ~10x cheaper than the regex on long texts, so the regex only runs on the
# few texts that pass it.
NEEDLES = {
    RE_WIDE: ("onvalid", "ONVALID", "NO se presentaron preguntas"),
    RE_NARROW: ("onvalid", "ONVALID"),
}
for _p, _ns in NEEDLES.items():  # the prefilter must be exact
    assert all(any(n in alt for n in _ns) for alt in _p.split("|")), _p


def _hint(c: Column, pattern: str) -> Column | None:
    needles = NEEDLES.get(pattern)
    if not needles:
        return None
    h = None
    for n in needles:
        h = c.contains(n) if h is None else (h | c.contains(n))
    return h


def matches(c, pattern: str) -> Column:
    """Regex search (not anchored), NULL-propagating."""
    c = as_col(c)
    h = _hint(c, pattern)
    if h is None:
        return c.rlike(pattern)
    return F.when(c.isNull(), F.lit(None)).when(h, c.rlike(pattern)).otherwise(F.lit(False))


def match_count(c, pattern: str) -> Column:
    """Number of non-overlapping matches, like ``len(re.findall(...))``."""
    c = as_col(c)
    full = F.regexp_count(c, F.lit(pattern)).cast("bigint")
    h = _hint(c, pattern)
    if h is None:
        return full
    return F.when(c.isNull(), F.lit(None)).when(h, full).otherwise(F.lit(0).cast("bigint"))


def process_code(ocid, prefix: str = OCID_PREFIX) -> Column:
    """ST-1: text between the publisher prefix and the *last* ``-``.

    The id must start with the prefix and leave at least one character
    before that last dash; otherwise NULL.
    """
    pat = "^" + _quote(prefix) + "(.+)-"
    return F.nullif(F.regexp_extract(as_col(ocid), pat, 1), F.lit(""))


def url_tail(url) -> Column:
    """ST-2: last path segment of a URL (text after the last ``/``); NULL if empty."""
    return F.nullif(F.regexp_extract(as_col(url), "(?<=/)[^/]*$", 0), F.lit(""))


def strip_tags(html) -> Column:
    """ST-3: remove every ``<...>`` tag."""
    return F.regexp_replace(as_col(html), _TAG, "")


def first_link(html, base: str = HARVEST_BASE_URL) -> Column:
    """ST-6: base URL + text between ``href="`` and ``,">`` (greedy within a line)."""
    target = F.nullif(F.regexp_extract(as_col(html), '(?<=href=")[^\\n]*(?=,">)', 0), F.lit(""))
    return F.concat(F.lit(base), target)


def text_lines(text) -> Column:
    """ST-4: split into lines like ``str.splitlines`` (no trailing empty line)."""
    # \z, not $: Java's $ also matches before a final line break
    t = F.regexp_replace(as_col(text), f"({_LINE_BREAK})\\z", "")
    return F.when(as_col(text) == "", F.array().cast("array<string>")).otherwise(
        F.split(t, _LINE_BREAK))


def no_spaces(c) -> Column:
    """ST-7: drop every space character."""
    return F.replace(as_col(c), F.lit(" "), F.lit(""))


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)
