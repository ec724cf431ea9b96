"""Keys that group comparable items: base keys, feature tokens, bands."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A number as in keys: integral ones without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def base_key(item: Column, stars: Column | None = None, count: Column | None = None, variant: Column | None = None) -> Column:
    """ITEM[*stars][xCOUNT][~variant]; parts that are null, zero, single or empty are left out."""
    none = F.lit("")
    parts = [item]
    if stars is not None:
        parts.append(F.when(stars > 0, F.concat(F.lit("*"), number(stars))).otherwise(none))
    if count is not None:
        parts.append(F.when(count > 1, F.concat(F.lit("x"), number(count))).otherwise(none))
    if variant is not None:
        parts.append(F.when(F.length(variant) > 0, F.concat(F.lit("~"), variant)).otherwise(none))
    return F.concat(*parts)


def book_key(enchantments: Column) -> Column:
    """BOOK: and the sorted name=level pairs of a map, or BOOK:plain."""
    pairs = F.array_sort(F.transform(F.map_entries(enchantments), lambda e: F.concat(e["key"], F.lit("="), number(e["value"]))))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, F.concat(F.lit("BOOK:"), F.array_join(pairs, ","))).otherwise("BOOK:plain")


def pet_key(kind: Column, tier: Column, band: Column, candied: Column) -> Column:
    return F.concat(F.lit("PET:"), kind, F.lit(":"), tier, F.lit(":"), band, F.when(candied, F.lit(":candy")).otherwise(""))


def strip_stars(key: Column) -> Column:
    return F.regexp_replace(key, r"^([^*]*)\*[0-9.]+", "$1")


def final_key(base: Column, tokens: Column) -> Column:
    """base, and # with the sorted significant tokens joined by +."""
    joined = F.array_join(F.array_sort(tokens), "+")
    return F.when(F.length(joined) > 0, F.concat(base, F.lit("#"), joined)).otherwise(base)


def always_splits(token: Column) -> Column:
    return token.startswith("skin:") | token.startswith("petskin:") | token.isin("x:shiny", "pethled:PET_ITEM_TIER_BOOST")


def level_of(experience: Column, costs: list[float], top: int) -> Column:
    """The level that accumulated experience reaches, given each level's cost."""
    sums = F.array(*(F.lit(float(x)) for x in accumulate(costs)))
    return F.least(F.size(F.filter(sums, lambda c: c <= experience)) + 1, F.lit(top))


def level_band(level: Column, top: int) -> Column:
    if top > 100:
        return F.when(level >= top, "max").when(level >= 150, "l150").otherwise("l100")
    return F.when(level >= top, "max").when(level >= 90, "l90").when(level >= 50, "l50").otherwise("l1")


def bid_band(bid: Column, cap: int = 10, step: float = 10e6) -> Column:
    return F.least(F.floor(bid / step), F.lit(cap)).cast("int")


def digits_band(coins: Column) -> Column:
    return F.length(F.floor(coins).cast("bigint").cast("string"))


def ladder_band(x: Column, steps: list[float]) -> Column:
    """How many of the ascending steps x has reached."""
    return sum((F.when(x >= s, 1).otherwise(0) for s in steps), F.lit(0)).cast("int")


def magnitude_band(x: Column) -> Column:
    return F.when(x >= 1, F.floor(F.log10(x)).cast("int")).otherwise(F.lit(0))


def lore_weight(lore: Column) -> Column:
    """The number behind 'Current weight:', colour codes left out."""
    plain = F.regexp_replace(lore, "§.", "")
    return F.try_to_number(F.nullif(F.replace(F.regexp_extract(plain, r"Current weight:\s*([0-9,]+)", 1), F.lit(","), F.lit("")), F.lit("")), F.lit("9999999999")).cast("bigint")


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "§.|%%[a-z_]+%%", ""))


def tick_up(p: Column) -> Column:
    return (F.floor(p * 10) + 1) / 10


def tick_down(p: Column) -> Column:
    return (F.ceil(p * 10) - 1) / 10
