"""Typed evidence in a text: which types, how good, and which values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridicta.functions.expressions import dbl, free, has, re_
from veridicta.functions.packs import EVIDENCE, KPI_VALUES
from veridicta.functions.patterns import Patterns
from veridicta.plans.shipping import ship


def types_of(text: str = "text", pack=EVIDENCE, find: Callable[[str], Column] | None = None) -> Column:
    """The types with a hit in the text itself, in the pack's order; context has no say.  ``find``: how to look for a
    pattern, if not by searching."""
    find = find or (lambda p: has(text, p))

    def any_of(e):
        out = find(e.patterns[0])
        for p in e.patterns[1:]:
            out = out | find(p)
        return out

    return F.array_compact(F.array(*(F.when(any_of(e), e.name) for e in pack)))


def _group(pattern: str) -> int:
    """The first capturing group, if there is one."""
    plain = pattern.replace(r"\(", "").replace("(?", "")
    return 1 if "(" in plain else 0


def matches_of(text: str = "text", pack=EVIDENCE, most: int = 5) -> Column:
    """type -> distinct matched strings, sorted, ``most`` at most."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = [F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(re_(p)), F.lit(_group(p))) for p in e.patterns))) for e in pack]
    both = F.arrays_zip(F.array(*(F.lit(e.name) for e in pack)).alias("k"), F.array(*(F.slice(F.array_sort(F.array_distinct(f)), 1, most) for f in found)).alias("v"))
    return F.map_filter(F.map_from_entries(both), lambda _, v: F.size(v) > 0)


def quality(types: Column, pack=EVIDENCE) -> Column:
    """Share of the pack's weight that the types hold."""
    total = 0.0
    for e in pack:
        total += e.weight
    got = dbl(0)
    for e in pack:
        got = got + F.when(F.array_contains(types, e.name), dbl(e.weight)).otherwise(dbl(0))
    return F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.least(got / dbl(total), dbl(1))).otherwise(dbl(0))


def kpi_values(text: str = "text", patterns=KPI_VALUES, most: int = 10, may: Callable[[str], Column] | None = None) -> Column:
    """Distinct values, sorted, ``most`` at most.  ``may``: whether to search for a pattern at all."""
    c, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")
    found = {p: F.regexp_extract_all(c, F.lit(re_(p)), F.lit(1)) for p in patterns}
    all_ = F.flatten(F.array(*(F.when(may(p), x).otherwise(none) if may else x for p, x in found.items())))
    return F.slice(F.array_sort(F.array_distinct(F.transform(all_, lambda x: F.trim(x)))), 1, most)


def detect(df: DataFrame, text: str = "text", pack=EVIDENCE, kpis=KPI_VALUES) -> DataFrame:
    """Adds has_evidence, evidence_types, kpi_values.  All patterns are looked for at once."""
    ship(df.sparkSession)
    known, (mask,) = Patterns([*(p for e in pack for p in e.patterns), *kpis]), free(df.columns, "mask")
    t, m = F.coalesce(F.col(text), F.lit("")), F.col(mask)
    df = df.withColumn(mask, known.mask(F.col(text)))
    df = df.withColumns({"evidence_types": types_of(text, pack, lambda p: known.has(m, t, p)), "kpi_values": kpi_values(text, kpis, may=lambda p: known.may(m, p))})
    return df.withColumn("has_evidence", F.size("evidence_types") > 0).drop(mask)
