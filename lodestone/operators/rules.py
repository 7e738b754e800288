"""Ordered rules, maps and tags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_match(rules: list[tuple[Column, tuple]], default: tuple, names: list[str]) -> Column:
    """A struct of the values of the first condition that holds; null conditions don't hold."""
    pack = lambda v: F.struct(*(F.lit(x).alias(n) for n, x in zip(names, v, strict=True)))
    out = pack(default)
    for cond, values in reversed(rules):
        out = F.when(cond, pack(values)).otherwise(out)
    return out


def mapped(c: Column, values: dict, default) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def tags(rules: list[tuple[Column, str]]) -> Column:
    """The tags whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules)))


def dose_band(amount: Column, reference: Column, trace: float = 0.1, caution: float = 3.0) -> Column:
    """struct(band, basis, allow): where an amount lies against its reference."""
    band = F.when(reference.isNull(), "unknown").when(amount < trace * reference, "trace").when(amount < reference, "meaningful").when(amount < caution * reference, "high").otherwise("caution")
    basis = F.when(reference.isNull(), "none").otherwise("reference")
    return F.struct(band.alias("band"), basis.alias("basis"), F.coalesce(amount >= trace * reference, F.lit(False)).alias("allow"))


#: Factors to milligrams (fixed values).
TO_MG = {"g": 1000.0, "mg": 1.0, "ug": 0.001, "mcg": 0.001, "µg": 0.001}


def converted(amount: Column, unit: Column, to: Column) -> Column:
    """The amount in another mass unit; unchanged where either unit is none."""
    a, b = mapped(F.lower(unit), TO_MG, None), mapped(F.lower(to), TO_MG, None)
    return F.coalesce(amount * a / b, amount)


def accepted(route: Column, pharmaceutical: Column, exposure: Column, evidence: Column) -> Column:
    """Oral route, no pharmaceutical, an accepted exposure and no preclinical evidence; nulls do not veto."""
    return (F.coalesce(route, F.lit("oral")) == "oral") & ~F.coalesce(pharmaceutical, F.lit(False)) & F.coalesce(exposure, F.lit("unclear")).isin("natural", "supplement", "unclear") & ~F.coalesce(evidence, F.lit("")).isin("animal", "in_vitro", "mechanistic")


def violations(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that fail; good and bad rows are then two filters on it."""
    return tags([(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks])
