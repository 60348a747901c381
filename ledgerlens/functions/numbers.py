"""Number parsing and arithmetic on columns. What can't be read is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DASH = r"^[-–—－]+$"


def lenient_number(cell: Column) -> Column:
    """A table cell as double: currency signs and separators stripped, brackets negate.

    Dashes, dates, percentages with text, units and empty cells are NULL.
    """
    s = F.regexp_replace(F.trim(cell), r"[\s 　]", "")
    s = F.regexp_replace(s, r"^(\()?(us\$|hk\$|rmb|usd|[$¥￥€£])", "$1")
    s = F.regexp_replace(s, r"[,，]", "")
    negative = s.rlike(r"^[(（].*[)）]$")
    body = F.regexp_replace(s, r"^[(（]|[)）]$", "")
    body = F.regexp_replace(body, r"^[$¥￥€£]", "")
    value = F.when(body.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), body.try_cast("double"))
    return F.when(s.rlike(_DASH) | (s == ""), None).when(negative, -value).otherwise(value)


def repair_amount(text: Column) -> Column:
    """Systematic misreadings of separators undone: 334.719.50 and 1, 234.5; NULL if the groups don't fit."""
    s = F.regexp_replace(F.trim(text), r"\s*([,.])\s*", "$1")
    dotted = s.rlike(r"^-?[0-9]{1,3}([.,][0-9]{3})+[.,][0-9]{2}$")
    whole = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.,]*)[.,][0-9]{2}$", 1), r"[.,]", "")
    cents = F.regexp_extract(s, r"[.,]([0-9]{2})$", 1)
    grouped = s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3}){2,}$")
    return F.when(dotted, F.concat(whole, F.lit("."), cents)).when(grouped, F.replace(s, F.lit("."), F.lit("")))


def amount(text: Column) -> Column:
    """struct<value, status>: ok, dash, empty, repaired or suspect."""
    s = F.trim(F.coalesce(text, F.lit("")))
    negative = s.rlike(r"^[(（].*[)）]$")
    body = F.regexp_replace(s, r"^[(（]|[)）]$", "")
    strict = body.rlike(r"^-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]{1,4})?$")
    plain = F.when(strict, F.replace(body, F.lit(","), F.lit("")).try_cast("double"))
    fixed = repair_amount(body).try_cast("double")
    sign = F.when(negative, -1.0).otherwise(1.0)
    status = F.when(s == "", "empty").when(s.rlike(_DASH), "dash").when(strict, "ok").when(fixed.isNotNull(), "repaired").otherwise("suspect")
    return F.struct((sign * F.when(strict, plain).otherwise(fixed)).alias("value"), status.alias("status"))


def looks_like_amount(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[(（]?-?[0-9][0-9,.\s]*[)）]?$|^[-–—]+$"), F.lit(False))


def row_number_like(text: Column) -> Column:
    """A small plain integer, at most 400: a line number rather than an amount."""
    return F.coalesce((F.trim(text).rlike("^[0-9]{1,3}$")) & (F.trim(text).try_cast("int") <= 400), F.lit(False))


def percent_number(text: Column) -> Column:
    """8.5% as 0.085, plain numbers as they are, others NULL."""
    s = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(s.endswith("%"), F.regexp_replace(s, "%$", "").try_cast("double") / F.lit(100.0)).otherwise(s.try_cast("double"))


def as_percent_text(text: Column) -> Column:
    """A list of bare numbers with a percent sign on each."""
    parts = F.transform(F.split(text, r"[,，;；\s]+"), lambda x: F.when(x.rlike(r"^-?[0-9.]+$"), F.concat(x, F.lit("%"))).otherwise(x))
    return F.array_join(F.filter(parts, lambda x: x != ""), ",")


def shares_number(text: Column) -> Column:
    """A share count, with the ten-thousand and hundred-million multipliers."""
    body = F.replace(F.regexp_extract(text, r"([0-9][0-9,]*\.?[0-9]*)", 1), F.lit(","), F.lit("")).try_cast("double")
    return body * F.when(text.rlike("亿"), 1e8).when(text.rlike("万"), 1e4).otherwise(1.0)


def close_to(a: Column, b: Column, ratio: float = 1e-6, least: float = 1.0) -> Column:
    """Equal within max(|a| * ratio, least); relative to the first argument."""
    return F.abs(a - b) <= F.greatest(F.abs(a) * ratio, F.lit(least))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
