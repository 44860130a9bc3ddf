"""Twelve-month vectors as column expressions.

Vectors are ``ARRAY`` columns of length 12, named by their column. Sets of months are 12-bit
integers: bit ``i`` is month ``i + 1``, and the circular year is a rotation of the bits.

Sums and rates are unrolled into plain expressions, which compile into their stage. The rest is
written with the array functions: unrolled as well, a stage would grow beyond the 8000 bytes up to
which the JVM compiles a method, and run interpreted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.rules import MONTH_SHORT, MONTHS, CoverageRules, PresenceRules

FULL_YEAR = (1 << MONTHS) - 1
YEAR = f"sequence(0, {MONTHS - 1})"


def at(vector: str, i: int) -> Column:
    """Element ``i`` (0-based)."""
    return F.expr(f"{vector}[{i}]")


def each_month(sql: str) -> Column:
    """A vector from an expression of the 0-based month ``i``."""
    return F.expr(f"transform({YEAR}, i -> {sql})")


def month_rows(where: str | None = None, **fields: str) -> Column:
    """Generator of one row per month ``i`` (that meets a condition) with the given fields."""
    listed = YEAR if where is None else f"filter({YEAR}, i -> {where})"
    struct = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return F.expr(f"inline(transform({listed}, i -> named_struct({struct})))")


def months_where(condition: str) -> Column:
    """Bit set of the months ``i`` that meet a condition."""
    return F.expr(f"aggregate({YEAR}, 0, (bits, i) -> bits + if({condition}, shiftleft(1, i), 0))")


def unrolled(sql: str) -> Column:
    """Twelve expressions put into one vector; ``{i}`` and ``{m}`` are the 0- and 1-based month."""
    return F.expr("array(" + ", ".join(sql.format(i=i, m=i + 1) for i in range(MONTHS)) + ")")


def sum_by_month(value: str, month: str = "month") -> Column:
    """Aggregate long rows (month, value) into a dense vector, zero where a month has no rows."""
    return unrolled(f"cast(coalesce(sum(CASE WHEN {month} = {{m}} THEN {value} END), 0) AS bigint)")


def sum_vectors(vector: str) -> Column:
    """Aggregate: element-wise sum of vectors."""
    return unrolled(f"cast(sum({vector}[{{i}}]) AS bigint)")


def count_positive(vector: str) -> Column:
    """Aggregate: rows with a positive element, per month."""
    return unrolled(f"count_if({vector}[{{i}}] > 0)")


def total_sql(vector: str) -> str:
    return "(" + " + ".join(f"{vector}[{i}]" for i in range(MONTHS)) + ")"


def total(vector: str) -> Column:
    return F.expr(total_sql(vector))


def dense_from_entries(entries: str) -> Column:
    """A vector from ``ARRAY<STRUCT<month, n>>``; months outside 1..12 are ignored."""
    return each_month(f"coalesce(try_element_at(map_from_entries({entries}), cast(i + 1 AS bigint)), 0L)")


def rates(counts: str, effort: str) -> Column:
    """Share of effort per month, 0 where there is no effort."""
    return unrolled(f"if({effort}[{{i}}] > 0, {counts}[{{i}}] / {effort}[{{i}}], 0D)")


def rounded(vector: str, digits: int = 4) -> Column:
    return F.expr(f"transform({vector}, x -> round(x, {digits}))")


def units(counts: str, effort: str, digits: int = 4) -> Column:
    """Rates rounded half up to whole units of 10^-digits, in whole-number arithmetic.

    Sums of these do not depend on row order, and no decimal rounding is done per value.
    """
    scale = 2 * 10**digits
    return F.expr(f"zip_with({counts}, {effort}, (c, t) -> if(t > 0, (c * {scale}L + t) div (2 * t), 0L))")


def from_units(units_vector: str, digits: int = 4) -> Column:
    return F.expr(f"transform({units_vector}, x -> x / {float(10**digits)!r}D)")


def present_floor(peak: str, rules: PresenceRules) -> Column:
    """Smallest rate of a present month. Above zero, so a month without records never reaches it; a
    species without any rate gets a floor that no share reaches."""
    return F.expr(f"if({peak} > 0, {rules.peak_share!r}D * {peak}, 2D)")


def present_set(rate: str, floor: str) -> Column:
    """Months whose rate reaches the floor, the last month shifted in first."""
    return F.expr(f"aggregate(reverse({rate}), 0, (bits, x) -> bits + bits + if(x >= {floor}, 1, 0))")


def surveyed_set(effort: str, rules: PresenceRules) -> Column:
    return months_where(f"{effort}[i] >= {rules.effort_floor}")


def in_set(bits: str, month: str) -> str:
    """SQL test: is the 0-based month (an expression, not negative) in the set, round the year."""
    return f"(shiftright({bits}, ({month}) % {MONTHS}) & 1) = 1"


def has_month(bits: str, i: int) -> Column:
    return F.expr(in_set(bits, str(i)))


def flags_vector(bits: str) -> Column:
    """The set as 0/1 flags."""
    return each_month(f"shiftright({bits}, i) & 1")


def rotated(bits: str, by: int) -> str:
    """SQL of the set with every month moved ``by`` months later, December into January."""
    k = by % MONTHS
    return bits if k == 0 else f"((shiftleft({bits}, {k}) | shiftright({bits}, {MONTHS - k})) & {FULL_YEAR})"


def run_ends(bits: str, length: int) -> str:
    """SQL of the months that end a circular run of at least ``length`` months."""
    return "(" + " & ".join(rotated(bits, k) for k in range(length)) + ")"


def longest_run(bits: str) -> Column:
    """Longest circular run of the set, at most 12."""
    return F.expr(" + ".join(f"if({run_ends(bits, k)} <> 0, 1, 0)" for k in range(1, MONTHS + 1)))


def latest_month(bits: str) -> str:
    """SQL of the set's 0-based month at or before month ``i``, going back round the year.

    Rotated so that month ``i`` is the highest bit, the highest set bit is the answer; NULL if the
    set is empty.
    """
    turned = f"((shiftleft({bits}, {MONTHS - 1} - i) | shiftright({bits}, i + 1)) & {FULL_YEAR})"
    return f"if({bits} = 0, null, pmod(length(bin({turned})) - 1 - ({MONTHS - 1} - i), {MONTHS}))"


def label(counts: str, present: str, surveyed: str, rules: PresenceRules) -> Column:
    """Resident, seasonal, passage or uncertain, from the month sets."""
    return F.expr(f"""
        CASE WHEN bit_count({surveyed}) < {rules.surveyed_months}
               OR {total_sql(counts)} < {rules.species_records} THEN 'uncertain'
             WHEN bit_count({surveyed} & ~{present}) <= {rules.resident_gaps} THEN 'resident'
             WHEN bit_count({present}) BETWEEN 1 AND {rules.passage_months}
               AND {run_ends(present, rules.passage_run + 1)} = 0 THEN 'passage'
             ELSE 'seasonal' END""")


def coverage_sql(effort: str, rules: CoverageRules = CoverageRules()) -> str:
    return f"CASE WHEN {effort} >= {rules.well} THEN 'well' WHEN {effort} >= {rules.some} THEN 'some' ELSE 'limited' END"


def coverage_vector(effort: str, rules: CoverageRules = CoverageRules()) -> Column:
    return F.expr(f"transform({effort}, t -> {coverage_sql('t', rules)})")


def ease_cubic(u: float) -> float:
    return 4 * u**3 if u < 0.5 else 1 - (2 - 2 * u) ** 3 / 2


def ease_smooth(u: float) -> float:
    return u * u * (3 - 2 * u)


def month_anchor(t: float) -> tuple[int, int, float]:
    """The two mid-month anchors around a fractional month and how far between them ``t`` lies."""
    shifted = (t - 0.5) % MONTHS
    first = int(shifted // 1)
    return first, (first + 1) % MONTHS, shifted - first


def blend_months(vector: str, t: float, ease: Callable[[float], float] = ease_cubic) -> Column:
    """Value at fractional month ``t`` (0 = start of January), eased between mid-month anchors."""
    first, second, part = month_anchor(t)
    s = ease(part)
    return F.expr(f"{vector}[{first}] * {1 - s!r}D + {vector}[{second}] * {s!r}D")


def between_months(a: Column, b: Column, part: Column | float) -> Column:
    """Month between two months, the short way round the year."""
    step = F.pmod(b, F.lit(12.0)) - F.pmod(a, F.lit(12.0))
    short = F.when(step > 6, step - 12).when(step < -6, step + 12).otherwise(step)
    return F.pmod(F.pmod(a, F.lit(12.0)) + short * part, F.lit(12.0))


def months_in_words(bits: str) -> Column:
    names = "array(" + ", ".join(f"'{m}'" for m in MONTH_SHORT) + ")"
    listed = f"array_join(transform(filter({YEAR}, i -> {in_set(bits, 'i')}), i -> {names}[i]), ', ')"
    return F.expr(f"""
        CASE WHEN {bits} = {FULL_YEAR} THEN 'Recorded in every month' WHEN {bits} = 0 THEN 'No records in any month'
             ELSE concat('Recorded in ', {listed}) END""")


def wide(vector: str, prefix: str) -> list[Column]:
    """The vector as twelve scalar columns ``<prefix>01`` .. ``<prefix>12`` for table sinks."""
    return [at(vector, i).alias(f"{prefix}{i + 1:02d}") for i in range(MONTHS)]


def from_wide(prefix: str) -> Column:
    return F.expr("array(" + ", ".join(f"{prefix}{m:02d}" for m in range(1, MONTHS + 1)) + ")")


def wide_total(prefix: str) -> Column:
    return F.expr(" + ".join(f"{prefix}{m:02d}" for m in range(1, MONTHS + 1)))
