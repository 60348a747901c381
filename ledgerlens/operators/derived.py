"""Figures derived from mapped statements: one row for each document, a column for each field.

Missing fields stay NULL; what is assumed is said in a column of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import part_of_total, within_scale

#: Liabilities that are not debt, by which debt is shown to be zero.
NON_DEBT = ["accounts_payable", "deferred_revenue", "accrued_liabilities", "employee_payable", "taxes_payable", "other_current_liabilities", "deferred_tax_liabilities", "other_noncurrent_liabilities"]
#: Fields without which an appraisal is of no use.
KEY_FIELDS = ["revenue", "operating_income", "da", "cfo"]
MIN_MAPPING_RATE = 0.5
#: Share of revenue within which depreciation is believed.
DA_BOUNDS = (0.001, 0.8)


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def pivot_fields(rows: DataFrame, key: str, fields: list[str], field: str = "field", value: str = "value", seq: str = "seq") -> DataFrame:
    """One row for each document: the first value of each field (W20); one shuffle for all fields."""
    first = lambda f: F.min_by(F.when(F.col(field) == f, F.col(value)), F.when((F.col(field) == f) & F.col(value).isNotNull(), F.col(seq))).alias(f)
    return rows.groupBy(key).agg(*(first(f) for f in fields))


def statement_net_debt(df: DataFrame) -> DataFrame:
    """Adds net_debt, net_debt_missing and net_debt_note.

    Short and long debt less cash and short investments. If a debt field is missing, debt counts as 0 only where the known
    other liabilities make up all liabilities; otherwise the figure is NULL.
    """
    short, long = _have(df, "short_term_debt"), _have(df, "long_term_debt")
    cash, invested = _have(df, "cash"), _have(df, "short_term_investments")
    known = reduce(lambda a, b: a + b, (_zero(_have(df, f)) for f in NON_DEBT))
    total = _have(df, "total_liabilities")
    reconciled = F.coalesce(F.abs(total - known) <= F.greatest(F.abs(total) * 1e-6, F.lit(1.0)), F.lit(False))
    complete = short.isNotNull() & long.isNotNull()
    has_debt, has_cash = (_zero(short) != 0) | (_zero(long) != 0), (_zero(cash) != 0) | (_zero(invested) != 0)
    debt = F.when(complete, short + long).when(reconciled, F.lit(0.0))
    value = F.when((complete & (has_debt | has_cash)) | (~complete & reconciled & has_cash), debt - _zero(cash) - _zero(invested))
    gaps = F.filter(F.array(F.when(short.isNull(), F.lit("short_term_debt")), F.when(long.isNull(), F.lit("long_term_debt"))), lambda x: x.isNotNull())
    note = F.when(~complete & reconciled, "other liabilities make up all: debt is 0").when(~complete, "only part of the debt fields")
    return df.withColumns({"net_debt": value, "net_debt_missing": F.when(value.isNull(), gaps), "net_debt_note": note})


def ebitda(df: DataFrame) -> DataFrame:
    """Adds ebitda = operating income + depreciation; NULL if either is."""
    return df.withColumn("ebitda", _have(df, "operating_income") + _have(df, "da"))


def minority_interest(df: DataFrame) -> DataFrame:
    """Adds minority (0 where the statement has none) and minority_defaulted."""
    m = _have(df, "minority_interest")
    return df.withColumns({"minority": _zero(m), "minority_defaulted": m.isNull()})


def total_da(notes: Column, income: Column, cash_flow_lines: Column) -> Column:
    """Depreciation from the notes unless 0 or missing, else the income line, else the sum of cash-flow lines."""
    lines = F.filter(cash_flow_lines, lambda x: x.isNotNull())
    summed = F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0.0), lambda a, x: a + x))
    return F.coalesce(F.when(notes != 0, notes), income, summed)


def history(df: DataFrame) -> DataFrame:
    """Adds ebitda_margin, da_share, capex_share, nwc_share (G24): NULL without revenue or a part; inventory is optional."""
    rev = F.when(_have(df, "revenue") != 0, _have(df, "revenue"))
    ar, ap = _have(df, "accounts_receivable"), _have(df, "accounts_payable")
    return df.withColumns(
        {
            "ebitda_margin": (_have(df, "operating_income") + _have(df, "da")) / rev,
            "da_share": _have(df, "da") / rev,
            "capex_share": F.abs(_have(df, "capex")) / rev,
            "nwc_share": (ar + _zero(_have(df, "inventory")) - ap) / rev,
        }
    )


def history_notes(df: DataFrame) -> DataFrame:
    """Adds notes: doubts about the ratios."""
    share = _have(df, "da") / F.when(_have(df, "revenue") != 0, _have(df, "revenue"))
    low, high = DA_BOUNDS
    within = lambda part, total: F.coalesce(part_of_total(_have(df, part), _have(df, total)), F.lit(True))
    found = [
        F.when(~share.between(low, high), F.lit("depreciation out of proportion to revenue")),
        F.when(_have(df, "inventory").isNull() & _have(df, "accounts_receivable").isNotNull(), F.lit("working capital without inventory")),
        F.when(~within("accounts_receivable", "total_current_assets"), F.lit("receivables above current assets")),
        F.when(~within("inventory", "total_current_assets"), F.lit("inventory above current assets")),
        F.when(~within("accounts_payable", "total_current_liabilities"), F.lit("payables above current liabilities")),
        F.when(~within("capex", "investing_outflow"), F.lit("capital spending above investing outflow")),
    ]
    return df.withColumn("notes", F.filter(F.array(*found), lambda x: x.isNotNull()))


def history_reasons(rows: DataFrame, key: str, wanted: dict[str, list[str]], field: str = "field", value: str = "value") -> DataFrame:
    """key, measure, reason (P23, P25): why a measure has no value: no table, no row or no number.

    ``wanted``: measure → [statement, field, …]; ``rows`` have key, stmt, field, value.
    """
    out = None
    for measure, (stmt, *names) in wanted.items():
        table, row = F.col("stmt") == stmt, (F.col("stmt") == stmt) & F.col(field).isin(names)
        state = F.when(F.count_if(row & F.col(value).isNotNull()) > 0, "ok").when(F.count_if(row) > 0, "no value").when(F.count_if(table) > 0, "no row").otherwise("no table")
        got = rows.groupBy(key).agg(state.alias("reason")).select(key, F.lit(measure).alias("measure"), "reason")
        out = got if out is None else out.unionByName(got)
    return out.where("reason <> 'ok'")


def missing_key_fields(df: DataFrame) -> DataFrame:
    """Adds missing_keys, and unusable where half of the income statement or more has no field."""
    gone = F.filter(F.array(*(F.when(_have(df, f).isNull(), F.lit(f)) for f in KEY_FIELDS)), lambda x: x.isNotNull())
    return df.withColumn("missing_keys", gone).withColumn("unusable", F.coalesce(_have(df, "income_rate") < MIN_MAPPING_RATE, F.lit(False)) | (F.size(gone) > 0))


def operating_income_check(df: DataFrame) -> DataFrame:
    """Adds operating_income_agrees: the stated and the summed figure within half a percent of revenue (V9)."""
    scale = F.coalesce(F.when(_have(df, "revenue") != 0, F.abs(_have(df, "revenue"))), F.abs(_have(df, "operating_income")))
    return df.withColumn("operating_income_agrees", within_scale(_have(df, "derived_operating_income"), _have(df, "operating_income"), scale))


def best_candidates(files: DataFrame, kind: str = "kind", mapped: str = "mapped", rate: str = "rate", statements: str = "statements") -> DataFrame:
    """The file of each kind with most mapped rows, then the best rate: eight rows and two statements at least."""
    fit = files.where((F.col(mapped) >= 8) & (F.col(statements) >= 2))
    rest = [c for c in files.columns if c != kind]
    return fit.groupBy(kind).agg(F.max_by(F.struct(*rest), F.struct(mapped, rate)).alias("_b")).select(kind, "_b.*")


def prefill(df: DataFrame, current: str, prior: str, out: str) -> DataFrame:
    """Adds growth on the year before, NULL where that isn't positive."""
    return df.withColumn(out, F.when(F.col(prior) > 0, F.col(current) / F.col(prior) - 1))


def fill_absent(config: DataFrame, facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Facts where the configuration has nothing, and <field>_source saying which it is."""
    both = config.join(facts.select(key, *(F.col(f).alias(f"_f_{f}") for f in fields)), key, "left")
    for f in fields:
        source = F.when(F.col(f).isNotNull(), "given").when(F.col(f"_f_{f}").isNotNull(), "statements").otherwise("missing")
        both = both.withColumn(f"{f}_source", source).withColumn(f, F.coalesce(f, f"_f_{f}")).drop(f"_f_{f}")
    return both
