"""Schema-driven reshaping (PR-3, PR-6, PR-7 / AG-8)."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.times import instant

DATE_NAME = re.compile("Date|date")  # case-sensitive search, as in the source


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """PR-3: every nested struct leaf becomes a top-level column named by its
    path (``tender.tenderPeriod.startDate``).  Arrays are left intact."""
    cols = []

    def walk(dtype: StructType, path: list[str]) -> None:
        for f in dtype.fields:
            p = path + [f.name]
            if isinstance(f.dataType, StructType):
                walk(f.dataType, p)
            else:
                c = F.col(p[0])
                for name in p[1:]:
                    c = c.getField(name)
                cols.append(c.alias(sep.join(p)))

    walk(df.schema, [])
    return df.select(*cols)


def parse_dates(df: DataFrame, pattern: re.Pattern = DATE_NAME) -> DataFrame:
    """PR-6: text columns whose *name* matches ``Date|date`` become instants
    (``try_cast`` — bad text is NULL); other columns are unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if pattern.search(f.name) and isinstance(f.dataType, StringType):
            c = instant(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def drop_all_null(df: DataFrame) -> DataFrame:
    """PR-7 / AG-8 (opt-in): drop the columns that are NULL in every row.

    One aggregation job counts the non-NULL values of every column at once
    (a single row comes back); the result's schema therefore depends on the
    data.
    """
    names = df.columns
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)]).first()
    keep = [n for i, n in enumerate(names) if counts[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{n}`") for n in keep])


def variant_leaves(schema: str) -> list[tuple[list[str], str]]:
    """(path, type) of the leaves of a variant schema such as ``OBJECT<a: OBJECT<b: BIGINT>, c: ARRAY<STRING>>``; arrays are leaves."""
    out: list[tuple[list[str], str]] = []

    def walk(kind: str, path: list[str]) -> None:
        if not kind.startswith("OBJECT<"):
            out.append((path, kind))
            return
        inside, depth, quoted, start = kind[len("OBJECT<"):-1], 0, False, 0
        for k, c in enumerate(inside + ","):
            if c == "`":
                quoted = not quoted
            elif not quoted:
                depth += (c in "<(") - (c in ">)")
                if c == "," and not depth and inside[start:k].strip():
                    field = inside[start:k].strip()
                    name, kind_ = re.fullmatch(r"(`(?:[^`]|``)*`|[^:]*): (.*)", field, re.S).groups()
                    walk(kind_, [*path, name[1:-1].replace("``", "`") if name[0] == "`" else name])
                    start = k + 1

    walk(schema, [])
    return out


def flatten_variant(df: DataFrame, col: str, sep: str = ".") -> DataFrame:
    """PR-3 with the schema that the data have: every leaf of the variants becomes a column named by its path.

    One pass collects the schema (one row comes back), so a field that nobody
    declared is a column as well.  Arrays, and leaves of differing types, are
    JSON text; a leaf that is null everywhere is a text column.
    """
    schema = df.agg(F.schema_of_variant_agg(col)).first()[0]
    cols = []
    for path, kind in variant_leaves(schema) if schema.startswith("OBJECT<") else []:
        if any("'" in name and '"' in name for name in path):
            raise ValueError(f"a field's name with both kinds of quotes: {path}")
        at = "$" + "".join(f'["{name}"]' if "'" in name else f"['{name}']" for name in path)
        if kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
            c = F.try_variant_get(col, at, "double")
        elif kind in ("BIGINT", "BOOLEAN", "STRING"):
            c = F.try_variant_get(col, at, kind)
        elif kind == "VOID":
            c = F.lit(None).cast("string")
        else:
            v = F.try_variant_get(col, at, "variant")
            c = F.when(v.isNotNull() & ~F.is_variant_null(v), F.to_json(v))
        cols.append(c.alias(sep.join(path)))
    return df.select(*cols)
