"""Money: parsing, choice of the comparable price, anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(text: Column) -> Column:
    """A number from a price text.

    With both separators the last one is decimal. A single kind is a thousands separator if three characters follow its
    last place, else a decimal one.
    """
    t = F.regexp_replace(F.regexp_replace(text, "[   ]", " "), r"(?i)(?:huf|ft|forint|,-|€|eur|\$|usd)", "")
    only = F.trim(F.regexp_replace(t, r"[^\d.,\s-]", ""))
    comma, dot = (F.when(F.instr(only, c) > 0, F.length(only) - F.instr(F.reverse(only), c)).otherwise(-1) for c in (",", "."))
    n = F.length(only) - 1
    no_dots, no_commas = F.replace(only, F.lit("."), F.lit("")), F.replace(only, F.lit(","), F.lit(""))
    plain = (
        F.when((comma >= 0) & (dot >= 0), F.when(comma > dot, F.regexp_replace(no_dots, ",", ".")).otherwise(no_commas))
        .when(comma >= 0, F.when(n - comma == 3, no_commas).otherwise(F.regexp_replace(only, "^([^,]*),", "$1.")))
        .when(dot >= 0, F.when(n - dot == 3, no_dots).otherwise(only))
        .otherwise(only)
    )
    return F.regexp_extract(F.regexp_replace(plain, r"\s", ""), r"^(-?\d*\.?\d+|-?\d+)", 1).try_cast("double")


def to_huf(amount: Column, minor_unit: Column) -> Column:
    """Whole units from an amount in minor units (0 to 6 places), half up."""
    return F.floor(amount / F.pow(F.lit(10.0), F.greatest(F.lit(0), F.least(F.lit(6), minor_unit))) + F.lit(0.5)).cast("bigint")


def comparable_price(current: Column, sale: Column, regular: Column, member: Column, coupon: Column, quantity: Column, in_stock: Column, *, allowed: tuple[str, ...] = ("regular", "sale"), require_in_stock: bool = False) -> Column:
    """struct(price, price_type, comparable, on_sale, reason) of a listing's prices."""
    current, sale, regular, member, coupon, quantity = (F.when(p > 0, p) for p in (current, sale, regular, member, coupon, quantity))
    chosen = F.coalesce(current, sale, regular)
    on_sale = F.coalesce(F.when(current.isNotNull(), current < regular).otherwise(sale.isNotNull()), F.lit(False))
    kind = F.when(chosen.isNull(), F.when(member.isNotNull(), "member").when(coupon.isNotNull(), "coupon").when(quantity.isNotNull(), "quantity").otherwise("unknown")).when(on_sale, "sale").otherwise("regular")
    swapped = chosen.isNotNull() & F.coalesce(F.coalesce(sale, F.when(on_sale, chosen)) > regular, F.lit(False))
    reason = (
        F.when(chosen.isNull() & (kind != "unknown"), F.concat(kind, F.lit("_only"))).when(chosen.isNull(), "no_price").when(swapped, "sale_above_regular")
        .when(~kind.isin(*allowed), "type_not_allowed").when(F.lit(require_in_stock) & (in_stock == False), "out_of_stock")  # noqa: E712
    )
    return F.struct(
        F.when(~swapped, F.coalesce(chosen, member, coupon, quantity)).alias("price"), F.when(swapped, "not_comparable").otherwise(kind).alias("price_type"),
        reason.isNull().alias("comparable"), on_sale.alias("on_sale"), reason.alias("reason"),
    )


@dataclass(frozen=True)
class AnomalyLimits:
    """Fixed values."""

    significant_pct: float = 15
    extreme_pct: float = 60
    magnitude: float = 8
    lowest: int = 500
    highest: int = 8_000_000


def anomaly(new: Column, previous: Column, median: Column, unit_price: Column, volume_ml: Column, limits: AnomalyLimits = AnomalyLimits()) -> Column:
    """struct(flags, quarantine, significance, delta, delta_pct) of a price against the one before and the market."""
    delta = F.when(previous > 0, new - previous)
    pct = F.floor(delta / previous * 10000 + F.lit(0.5)) / 100
    factor = F.when(previous > 0, new / previous)
    off = F.when(median > 0, new / median)
    low, high = new < limits.lowest, new > limits.highest
    confused = (unit_price != 0) & (volume_ml != 0) & (volume_ml != 1000) & (F.abs(new / unit_price - 1) < 0.02) & (F.abs(volume_ml / 1000 - 1) > 0.1)
    times100, over100 = off.between(90, 110), off.between(0.009, 0.011)
    jump = (factor >= limits.magnitude) | (factor <= 1 / limits.magnitude)
    extreme, significant = F.abs(pct) >= limits.extreme_pct, F.abs(pct) >= limits.significant_pct
    change = F.when(jump, "MAGNITUDE_CHANGE").when(extreme, "EXTREME_CHANGE").when(significant, "SIGNIFICANT_CHANGE")
    flags = F.array_compact(F.array(F.when(low, "IMPLAUSIBLY_LOW"), F.when(high, "IMPLAUSIBLY_HIGH"), F.when(confused, "UNIT_PRICE_CONFUSION"), F.when(times100, "MINOR_UNIT_SUSPECT_X100").when(over100, "MINOR_UNIT_SUSPECT_DIV100"), change))
    worst = F.coalesce(low | high, F.lit(False)) | F.coalesce(times100 | over100, F.lit(False)) | F.coalesce(jump | extreme, F.lit(False))
    flags = F.when(new.isNull(), F.array(F.lit("NO_PRICE"))).when(new <= 0, F.array(F.lit("NON_POSITIVE_PRICE"))).otherwise(flags)
    usable = F.coalesce(new > 0, F.lit(False))
    return F.struct(
        flags.alias("flags"), F.when(new.isNull(), False).when(new <= 0, True).otherwise(worst | F.coalesce(confused, F.lit(False))).alias("quarantine"),
        F.when(new.isNull(), "normal").when(~usable | worst, "extreme").when(F.coalesce(significant, F.lit(False)), "significant").otherwise("normal").alias("significance"),
        F.when(usable, delta).alias("delta"), F.when(usable, pct).alias("delta_pct"),
    )
