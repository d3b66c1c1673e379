"""Ratio formulas and ratings over base metric columns.

A zero amount counts as "not reported" throughout, so each formula is guarded by its operands being
different from zero and yields 0 otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterlight import dims

def _share(top: Column, bottom: Column, *needed: Column) -> Column:
    guard = reduce(lambda a, b: a & b, [c != 0 for c in (needed or (bottom,))])
    return F.when(guard, top / F.nullif(bottom, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


def profitability(m) -> dict[str, Column]:
    """Return on assets and equity, margin, efficiency, loan/deposit and problem-loan ratios."""
    annual = lambda c: m(c) * dims.QUARTERS_PER_YEAR
    revenue = m("net_interest_income") + m("noninterest_income")
    problem_loans = m("nonaccrual_loans") + m("past_due_90")
    return {
        "roa": _share(annual("net_income"), m("total_assets"), m("net_income"), m("total_assets")),
        "roe": _share(annual("net_income"), m("total_equity"), m("net_income"), m("total_equity")),
        "nim": _share(annual("net_interest_income"), m("total_assets"), m("net_interest_income"), m("total_assets")),
        "efficiency_ratio": F.when(
            revenue > 0, m("noninterest_expense") / F.nullif(revenue, F.lit(0.0)) * 100
        ).otherwise(F.lit(0.0)),
        "loan_deposit_ratio": _share(m("total_loans"), m("total_deposits")),
        "npl_ratio": _share(problem_loans, m("total_loans")),
    }


def asset_liability(m) -> dict[str, Column]:
    """Rate sensitivity, liquidity, funding and yield measures (first pass: no derived inputs)."""
    rsa, rsl = m("rate_sensitive_assets"), m("rate_sensitive_liabilities")
    liquid = m("cash_and_due") + m("securities_available_for_sale") + m("federal_funds_sold")
    wholesale = m("wholesale_funding") + m("other_borrowed_money") + m("large_time_deposits")
    expense = m("interest_expense_deposits") + m("interest_expense_borrowed")
    earning, bearing = m("earning_assets"), m("interest_bearing_liabilities")
    income = m("interest_income_loans")
    fixed = m("securities_held_to_maturity")
    variable = m("commercial_loans") * dims.VARIABLE_SHARE_OF_COMMERCIAL_LOANS
    yield_ = _share(income * dims.QUARTERS_PER_YEAR, earning, income, earning)
    cost = _share(expense * dims.QUARTERS_PER_YEAR, bearing, expense, bearing)
    mix = fixed + variable
    zero = F.lit(0.0)
    return {
        "ir_sensitivity_ratio": _share(rsa, rsl, rsa, rsl),
        "liquid_assets_ratio": _share(liquid, m("total_assets")),
        "wholesale_funding_ratio": _share(wholesale, m("total_assets")),
        "earning_asset_yield": yield_,
        "cost_of_funds": cost,
        "interest_rate_spread": yield_ - cost,
        "fixed_rate_asset_pct": F.when(mix > 0, fixed / F.nullif(mix, zero) * 100).otherwise(zero),
        "variable_rate_asset_pct": F.when(mix > 0, variable / F.nullif(mix, zero) * 100).otherwise(zero),
        "interest_rate_gap": rsa - rsl,
        "gap_ratio": _share(rsa - rsl, m("total_assets")),
        "deposit_stability_ratio": _share(m("total_deposits") - m("large_time_deposits"), m("total_deposits")),
    }


def composition(m) -> dict[str, Column]:
    """Share of loans, securities and cash in total assets."""
    assets = m("total_assets")
    securities = m("securities_available_for_sale") + m("securities_held_to_maturity")

    def of_assets(top: Column) -> Column:
        return F.when(assets > 0, top / F.nullif(assets, F.lit(0.0)) * 100).otherwise(F.lit(0.0))

    return {
        "loans_to_assets": of_assets(m("total_loans")),
        "securities_to_assets": of_assets(securities),
        "cash_to_assets": of_assets(m("cash_and_due")),
    }


def ratio_status(metric: Column, value: Column) -> Column:
    """Excellent / Good / Adequate / Needs Improvement, or N/A for an unrated metric."""
    rating = F
    for name, lo, hi, status in dims.RATIO_BANDS:
        hit = metric == name
        if lo is not None:
            hit = hit & (value >= lo)
        if hi is not None:
            hit = hit & (value < hi)
        rating = rating.when(hit, status)
    return rating.otherwise(dims.UNRATED)


def problem_loan_status(npl: Column) -> Column:
    return F.when(npl < 1, "Excellent").when(npl < 2, "Good").otherwise("Needs Attention")


def gap_flag(gap_ratio: Column) -> Column:
    return F.when(F.abs(gap_ratio) > 20, "high").when(F.abs(gap_ratio) > 10, "moderate").otherwise("normal")


def liquidity_flag(ratio: Column) -> Column:
    return F.when(ratio < 10, "low").when(ratio < 20, "moderate").otherwise("good")


def wholesale_flag(ratio: Column) -> Column:
    return F.when(ratio > 30, "high").when(ratio > 20, "moderate").otherwise("normal")


def stability_flag(ratio: Column) -> Column:
    return F.when(ratio < 70, "low").when(ratio < 80, "moderate").otherwise("good")
