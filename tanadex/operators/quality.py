"""Field completeness of extracted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tanadex.functions.text import strip
from tanadex.functions.scalars import network_location

# Default check of a field.
DEFAULT_CHECK = (0, 0.9)

NUMBER = r"^[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?$|^(?i)[+-]?(nan|inf|infinity)$"


def is_filled(col: Column) -> Column:
    text = strip(col)
    return F.coalesce((text != "") & ~F.lower(text).isin("none", "null"), F.lit(False))


def is_number(col: Column) -> Column:
    return F.coalesce(strip(F.replace(col, F.lit(","), F.lit(""))).rlike(NUMBER), F.lit(False))


def is_text(col: Column) -> Column:
    return F.coalesce(strip(col) != "", F.lit(False))


def is_url(col: Column) -> Column:
    text = strip(col)
    full = text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (network_location(text) != "")
    return F.coalesce((full | text.startswith("/")) & (text != ""), F.lit(False))


VALIDATORS = {0: is_filled, 1: is_number, 2: is_text, 3: is_url}


def validator(kind: int):
    return VALIDATORS.get(kind, is_filled)


def completeness(items: DataFrame, fields, checks: dict | None = None,
                 default=DEFAULT_CHECK, by=()) -> DataFrame:
    """Share of valid values per field, all fields in one pass; 0.0 without items.

    ``checks`` maps a field to (type, threshold); ``by`` adds grouping columns.
    """
    checks = checks or {}
    spec = {f: checks.get(f, default) for f in fields}
    ratios = items.groupBy(*by).agg(*[
        F.coalesce(F.avg(validator(kind)(F.col(f).cast("string")).cast("int")), F.lit(0.0)).alias(f)
        for f, (kind, _) in spec.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("completeness"),
                              F.lit(float(t)).alias("threshold"), F.lit(kind).alias("type"))
                     for f, (kind, t) in spec.items()])
    return ratios.select(*by, F.inline(rows))


def failed_fields(report: DataFrame) -> DataFrame:
    return report.where(F.col("completeness") < F.col("threshold"))


def crawl_summary(records: DataFrame) -> DataFrame:
    """Per site and page: extracted items and errors."""
    return (records.groupBy("site", "url")
            .agg(F.sum(F.size("items")).cast("bigint").alias("n_items"),
                 F.sum(F.size("errors")).cast("bigint").alias("n_errors")))
