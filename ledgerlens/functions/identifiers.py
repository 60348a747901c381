"""Dates, periods, and codes of securities and filers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits in Chinese numerals, and what they stand for.
CN_DIGITS = ("〇○零一二三四五六七八九", "000123456789")


def days_between(start: Column, end: Column) -> Column:
    """Days from start to end, NULL if either isn't a date."""
    return F.datediff(_date(end), _date(start))


def _date(x: Column) -> Column:
    return F.try_to_date(x.cast("string"), "yyyy-MM-dd")


def period_key(text: Column) -> Column:
    """Date of the period a header names: a full date, a month's or a year's end; NULL if none."""
    t = F.translate(text, *CN_DIGITS)
    full = F.regexp_extract(t, r"((?:19|20)[0-9]{2})[-/.年]\s*([0-9]{1,2})[-/.月]\s*([0-9]{1,2})", 0)
    part = lambda k: F.regexp_extract(t, r"((?:19|20)[0-9]{2})[-/.年]\s*([0-9]{1,2})[-/.月]\s*([0-9]{1,2})", k).try_cast("int")
    year = F.regexp_extract(t, r"((?:19|20)[0-9]{2})", 1).try_cast("int")
    month = F.regexp_extract(t, r"(?:19|20)[0-9]{2}[-/.年]\s*([0-9]{1,2})\s*月", 1).try_cast("int")
    return F.when(full != "", F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).cast("date")).when(
        month.between(1, 12), F.last_day(F.make_date(year, month, F.lit(1)))
    ).when(year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31)))


def strict_report_date(text: Column) -> Column:
    """A quarter end as yyyy-MM-dd or yyyyMMdd; anything else raises."""
    compact = F.regexp_replace(F.trim(text), "-", "")
    date = F.when(compact.rlike("^[0-9]{8}$"), F.try_to_date(compact, "yyyyMMdd"))
    fits = date.isNotNull() & F.date_format(date, "MMdd").isin("0331", "0630", "0930", "1231")
    return F.when(text.isNull(), F.lit(None).cast("date")).when(fits, date).otherwise(F.raise_error(F.concat(F.lit("not a report date: "), text)).cast("date"))


def _padded(digits: Column, size: int) -> Column:
    """Zeros in front up to a size; a longer value stays as it is."""
    return F.when(F.length(digits) < size, F.lpad(digits, size, "0")).otherwise(digits)


def filer_key(cik: Column) -> Column:
    """A filer number of ten digits or more, whatever zeros it came with; NULL for what isn't a number."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(cik.cast("string")), "^(?i)cik", ""), "^0+(?=[0-9])", "")
    return F.when(digits.rlike("^[0-9]+$"), _padded(digits, 10))


def hk_code(code: Column) -> Column:
    """The digits of a code, five or more; NULL without any."""
    digits = F.regexp_replace(code.cast("string"), "[^0-9]", "")
    return F.when(digits != "", _padded(digits, 5))


def cn_security(code: Column) -> Column:
    """600000 as 600000.SH, 0 and 3 as .SZ, 4, 8 and 92 as .BJ; NULL for other codes, also longer ones."""
    c = _padded(F.trim(code.cast("string")), 6)
    of = lambda start, market: F.when(c.rlike(f"^(?:{start})[0-9]*$") & (F.length(c) == 6), F.concat(c, F.lit(market)))
    return F.coalesce(of("[48]|92", ".BJ"), of("6", ".SH"), of("[03]", ".SZ"))


def market_of(code: Column) -> Column:
    """us, hk or cn by the shape of a code; NULL if none fits."""
    c = F.upper(F.trim(code))
    return F.when(cn_security(c).isNotNull() & c.rlike("^[0-9]{6}$"), "cn").when(c.rlike(r"^[0-9]{1,5}(\.HK)?$"), "hk").when(c.rlike(r"^[A-Z][A-Z.\-]{0,9}$"), "us")


def ticker_list(text: Column) -> Column:
    """Codes of a free-hand list: upper case, split at commas, semicolons, enumeration marks and blanks."""
    return F.filter(F.split(F.upper(text), r"[,，;；、\s]+"), lambda x: x != "")


def duration_kind(days: Column) -> Column:
    """annual, quarter, half, ytd9 or other, by inclusive day ranges; NULL for instants."""
    return (
        F.when(days.between(330, 400), "annual").when(days.between(80, 100), "quarter").when(days.between(170, 190), "half")
        .when(days.between(260, 285), "ytd9").when(days.isNotNull(), "other")
    )


def duration_between(days: Column, kind: str | int) -> Column:
    """Whether a span fits a named range, or a number of days give or take 15."""
    bounds = {"annual": (330, 400), "quarter": (80, 100), "half": (170, 190), "ytd9": (260, 285), "ytd": (80, 330)}
    if isinstance(kind, int):
        low, high = kind - 15, kind + 15
    elif kind in bounds:
        low, high = bounds[kind]
    else:
        raise ValueError(f"unknown duration {kind!r}; one of {sorted(bounds)} or days")
    return F.coalesce(days.between(low, high), F.lit(False))
