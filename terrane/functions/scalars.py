"""The rules of the survey's reports as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres that one vine takes in a row.
VINE_SPACING = 1.2


def share(part: Column, whole: Column) -> Column:
    """0 where there is no whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def capped_share(part: Column, whole: Column) -> Column:
    return F.least(share(part, whole), F.lit(1.0))


def block_status(disrupted: Column) -> Column:
    """green below a tenth, yellow to three tenths and with it, red above."""
    return F.when(disrupted < 0.10, "green").when(disrupted <= 0.30, "yellow").otherwise("red")


def half_even(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def missing_vines(gap: Column, spacing: float = VINE_SPACING) -> Column:
    return half_even(gap / spacing).cast("long")


def density(row_spacing: Column, vine_spacing: Column | float) -> Column:
    """Vines per hectare."""
    return 10000 / (row_spacing * vine_spacing)


def tolerance_class(deviation: Column, good: float, fair: float) -> Column:
    return F.when(F.abs(deviation) <= good, "pass").when(F.abs(deviation) <= fair, "warn").otherwise("fail")


def grade(v: Column, ok: float, warn: float, higher_is_better: bool = True) -> Column:
    better = (lambda x: v >= x) if higher_is_better else (lambda x: v <= x)
    return F.when(better(ok), "PASS").when(better(warn), "WARN").otherwise("FAIL")


def cover_class(vegetation: Column) -> Column:
    return F.when(vegetation < 0.25, "bare_soil").when(vegetation > 0.75, "vegetation").otherwise("mixed")


def structure(longest_gap: Column, limit: float = 5.5, inclusive: bool = False) -> Column:
    """The detector takes a gap above the limit, the continuation one that reaches it."""
    return F.when((longest_gap >= limit) if inclusive else (longest_gap > limit), "disrupted").otherwise("regular")


def count_score(found: Column, expected: Column, tolerance: float) -> Column:
    return F.when(expected == 0, F.when(found == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(found - expected) / expected / tolerance))


def f1(hits: Column, found: Column, expected: Column) -> Column:
    """1 if nothing is expected and nothing found."""
    p, r = share(hits, found), share(hits, expected)
    return F.when((found == 0) & (expected == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def band_of(value: Column, bands: Column) -> Column:
    """The first of an array of (min, max, ...) structs whose closed range holds the value, else the first of all."""
    return F.coalesce(F.get(F.filter(bands, lambda b: value.between(b["min"], b["max"])), F.lit(0)), bands[0])


def eligible_amount(measured: Column, declared: Column, rate: Column, bonus: Column, least_area: float) -> Column:
    """On the smaller area, nothing below the least one; to hundreds."""
    paid = F.when(measured >= least_area, F.least(measured, declared)).otherwise(0.0)
    return (half_even(F.round(paid * (rate + bonus), 2) / 100) * 100).cast("long")


def worst(*statuses: Column) -> Column:
    """fail before warn before the rest."""
    all_of = F.array(*statuses)
    return F.when(F.array_contains(all_of, "fail"), "fail").when(F.array_contains(all_of, "warn"), "warn").otherwise("pass")


def detected_status(measured_ha: Column, parcel_ha: Column, vegetation: Column, gap: Column, least: float = 0.1, green: float = 0.6, holes: float = 0.4) -> Column:
    return F.when(measured_ha < least * parcel_ha, "no_vines").when((vegetation > green) & (gap > holes), "abandoned").otherwise("planted")


def minutes(metres: Column, km_per_hour: float = 4.0) -> Column:
    return metres / (km_per_hour * 1000 / 60)


def target_value(kind: Column, gap: Column) -> Column:
    """What a visit is worth: waste most, long gaps more than short ones."""
    return F.when(kind == "waste", 10.0).when(F.coalesce(gap, F.lit(0.0)) >= 5, 3.0).otherwise(1.0)


def application_state(status: Column, eligible: Column, requested: Column) -> Column:
    """stage and decision of an application from its block's status and, once it is settled, the amounts."""
    settled = eligible.isNotNull()
    stage = F.when(settled & (eligible < requested), "decision").when(settled, "payment").when(status == "noncompliant", "evaluation").when(status == "review", "field check").otherwise("administrative check")
    return F.struct(stage.alias("stage"), F.when(settled & (eligible < requested), status).when(settled, "approved").alias("decision"))


def correction(n_old: Column, n_new: Column, turned: Column, second: Column, second_turned: Column, at_corner: Column) -> Column:
    """What an annotator is to do about a tile, from the rows of two versions and their directions.

    turned: the main directions differ and no second one agrees; second: the new version has a second direction; second_turned: none of
    these is near the old one. Fixed values: half as many again and five more rows make a tile to be cleaned.
    """
    one_sided = F.when((n_old > 0) & (n_new == 0), F.when(at_corner, "check").otherwise("empty")).when((n_new > 0) & (n_old == 0), "add")
    both = F.when(turned, "redo").when(second & second_turned, "second").when((2 * n_old >= 3 * n_new) & (n_old - n_new >= 5), "clean").otherwise("ok")
    return F.coalesce(one_sided, F.when((n_old > 0) & (n_new > 0), both).otherwise("ok"))
