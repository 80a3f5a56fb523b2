"""Row-level rules on dates, numbers, text, arrays and maps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def round_int(x: Column) -> Column:
    """Round half to even, to a whole number."""
    return F.bround(x, 0).cast("int")


def lockbox_days(start: Column, end: Column, pct: Column) -> Column:
    return F.greatest(F.lit(1), round_int(F.datediff(end, start) * pct))


def split_date_range(start: Column, end: Column, pct: Column) -> Column:
    """struct(train_end, lockbox_start), NULL where the range cannot be split."""
    total = F.datediff(end, start)
    days = lockbox_days(start, end, pct)
    ok = (pct > 0) & (pct < 1) & (total >= 2) & (days < total)
    return F.when(
        ok,
        F.struct(
            F.date_sub(F.date_sub(end, days), 1).alias("train_end"),
            F.date_sub(end, days).alias("lockbox_start"),
        ),
    )


def trading_days(start: Column, end: Column) -> Column:
    """Approximate number of trading days in a calendar range."""
    return F.greatest(F.lit(2), round_int(F.datediff(end, start) * TRADING_DAYS / 365))


def annualize(total_return_pct: Column, span_days: Column) -> Column:
    base = F.greatest(1 + total_return_pct / 100, F.lit(1e-9))
    return F.when(span_days <= 0, 0.0).otherwise((F.pow(base, 365.0 / span_days) - 1) * 100)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_number(text: Column) -> Column:
    return finite(text.try_cast("double"))


def _trimmed(assets: Column) -> Column:
    return F.filter(F.transform(assets, lambda a: F.trim(a)), lambda a: a != "")


def dedupe_assets(assets: Column) -> Column:
    """Trim, drop blanks, keep the first spelling of each name regardless of case."""
    # An expression inside a lambda is worked out again for every element; a lambda's argument is not.
    trimmed = _trimmed(assets)
    both = F.array(F.struct(trimmed.alias("names"), F.transform(trimmed, lambda a: F.lower(a)).alias("lowered")))
    kept = F.transform(both, lambda b: F.filter(b["names"], lambda a, i: F.array_position(b["lowered"], F.lower(a)) == i + 1))
    return F.get(kept, F.lit(0))


def n_assets(assets: Column) -> Column:
    """The size of dedupe_assets(assets)."""
    return F.size(F.array_distinct(F.transform(_trimmed(assets), lambda a: F.lower(a))))


def portfolio_label(assets: Column) -> Column:
    return F.concat(F.lit("PORTFOLIO["), F.array_join(assets, ","), F.lit("]"))


def assets_from_label(label: Column) -> Column:
    """The asset list written in a portfolio label, or the single asset itself."""
    inner = F.regexp_extract(label, r"^PORTFOLIO\[(.*)\]$", 1)
    parts = F.filter(
        F.transform(F.split(inner, ","), lambda a: F.trim(a)), lambda a: a != ""
    )
    is_list = label.startswith("PORTFOLIO[") & label.endswith("]")
    return F.when(is_list, parts).when(label != "", F.array(label)).otherwise(
        F.array().cast("array<string>")
    )


def tokens(text: Column) -> Column:
    """Lower-case search tokens of two characters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_.-]+)"), 1)
    return F.filter(found, lambda t: F.length(t) > 1)


def map_number(params: Column, key: str, default: float | None = None) -> Column:
    """A numeric entry of a string map, or the default."""
    return F.coalesce(safe_number(F.try_element_at(params, F.lit(key))), F.lit(default))


def neighbours(value: Column, factors: tuple[float, ...]) -> Column:
    """Distinct whole-number neighbours of a parameter, truncated toward zero."""
    return F.array_distinct(F.array(*[(value * f).cast("int") for f in factors]))


def packed_key(*parts: tuple[Column, int]) -> Column:
    """Whole numbers of at most the given digits as one DECIMAL(38, 0) that sorts like the tuple.
    Unlike a struct it can be updated in place, so min_by and max_by over it hash instead of sort."""
    assert sum(digits for _, digits in parts) <= 38
    shift, out = 0, None
    for part, digits in reversed(parts):
        one = part.cast("decimal(38,0)") * F.lit(Decimal(10**shift)).cast("decimal(38,0)")
        out = one if out is None else out + one
        shift += digits
    return out.cast("decimal(38,0)")
