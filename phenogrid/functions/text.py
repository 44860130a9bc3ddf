"""Text, name and number formatting as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.rules import MONTH_SHORT, MONTHS, WEIGHTS


def clean(value: Column) -> Column:
    """Trimmed, and NULL when nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def photo_caption(filename: Column) -> Column:
    """Sex named in a file name; female is looked for first because it contains male."""
    f = F.lower(filename)
    return (
        F.when(f.rlike(r"\bfemale\b|\(f\)|_f\b| f\."), "Female")
        .when(f.rlike(r"\bmale\b|\(m\)"), "Male")
        .otherwise("")
    )


ENTITY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{1,31};?)"


def _code_point(code: Column) -> Column:
    """The character of a number: a few of 0x80..0x9F are read as Windows-1252, impossible ones as the replacement mark."""
    western = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}
    named = F.from_json(F.lit(json.dumps({n: c for n, c in western.items() if c != "\ufffd"})), "map<string,string>")
    known = F.try_element_at(named, code.cast("string"))
    impossible = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | (code % 65536 >= 65534)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(impossible, F.lit(63)).otherwise(code)), 8, "0")), "UTF-32")
    return F.when(known.isNotNull(), known).when(impossible, F.lit("\ufffd")).when(control, F.lit("")).otherwise(plain)


LONGEST_NAME = max(map(len, html5)) + 1


def _names_by_slot() -> list[dict[str, str]]:
    """The names of the entities by first letter and length, so that a look-up meets only those of its own kind."""
    slots: list[dict[str, str]] = [{} for _ in range(52 * LONGEST_NAME)]
    for name, text in html5.items():
        slots[(ord(name[0]) - (65 if name[0] < "a" else 71)) * LONGEST_NAME + len(name)][name] = text
    return slots


def _entity(hit: Column) -> Column:
    """One entity resolved: a number, or the longest known name at its start; anything else stays as it is."""
    names = F.from_json(F.lit(json.dumps(_names_by_slot())), "array<map<string,string>>")
    body = F.substr(hit, F.lit(2))
    letter = F.ascii(body)
    slot = F.when(letter < 97, letter - 65).otherwise(letter - 71) * LONGEST_NAME
    digits = F.rtrim(body, F.lit(";"))
    number = F.when(body.startswith("#x") | body.startswith("#X"), F.conv(F.substr(digits, F.lit(3)), 16, 10).try_cast("decimal(20,0)")).otherwise(
        F.substr(digits, F.lit(2)).try_cast("decimal(20,0)")
    )
    code = F.when(number <= 0x110000, number).otherwise(F.lit(0x110000)).cast("long")
    longest = F.least(F.length(body), F.lit(LONGEST_NAME - 1))
    sizes = F.filter(F.sequence(longest, F.lit(2), F.lit(-1)), lambda n: F.map_contains_key(F.get(names, slot + n), F.substr(body, F.lit(1), n)))
    size = F.get(sizes, F.lit(0))
    named = F.concat(F.try_element_at(F.get(names, slot + size), F.substr(body, F.lit(1), size)), F.substr(body, size + 1))
    return F.when(body.startswith("#"), _code_point(code)).otherwise(F.coalesce(named, hit))


def unescape_html(value: Column) -> Column:
    """Named and numeric entities resolved once, left to right; only texts with an ampersand are taken apart."""
    resolved = F.zip_with(
        F.split(value, ENTITY, -1), F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0)),
        lambda gap, hit: F.concat(gap, F.coalesce(_entity(hit), F.lit(""))),
    )
    return F.when(value.contains("&"), F.array_join(resolved, "")).otherwise(value)


def strip_html(value: Column) -> Column:
    """Tags dropped, entities resolved, trimmed of any white space."""
    text = unescape_html(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", ""))
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def strip_tracking(url: Column) -> Column:
    """The address without its ``utm_`` parameters."""
    base = F.substring_index(url, "?", 1)
    query = F.substring(url, F.length(base) + 2, F.length(url))
    kept = F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_"))
    rest = F.array_join(kept, "&")
    return F.when(~F.contains(url, F.lit("?")), url).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), rest))


def upper_first(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, F.lit(2), F.length(value)))


def display_name(sci: Column, *candidates: Column) -> Column:
    """First candidate that says more than the scientific name, else the scientific name."""
    usable = [F.when((c != "") & (F.lower(c) != F.lower(sci)), c) for c in candidates]
    return upper_first(F.coalesce(*usable, sci))


def english_name(vernaculars: Column) -> Column:
    """First English entry of ``ARRAY<STRUCT<name, language>>``, empty when there is none."""
    english = F.filter(vernaculars, lambda v: v["language"].isin("eng", "en") & (v["name"] != ""))
    return F.coalesce(F.get(english, F.lit(0))["name"], F.lit(""))


def formula_safe(value: Column) -> Column:
    """Text a spreadsheet will not run as a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_field(value: Column) -> Column:
    """RFC 4180 field of a text value."""
    safe = formula_safe(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike('[",\n\r]'), quoted).otherwise(safe)


def indian_number(value: Column) -> Column:
    """Whole number with the last three digits grouped, then pairs (12,34,567).

    The digits are bound as a lambda variable, so they are computed once however often they are used.
    """

    def grouped(digits: Column) -> Column:
        head = F.substring(digits, F.lit(1), F.length(digits) - 3)
        tail = F.substring(digits, F.length(digits) - 2, F.lit(3))
        pairs = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
        return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(pairs, F.lit(","), tail))

    text = F.get(F.transform(F.array(F.abs(value).cast("long").cast("string")), grouped), F.lit(0))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def _kilograms(value: Column) -> Column:
    tenths = half_up(value / 100)
    whole = F.floor(tenths / 10).cast("long")
    part = F.pmod(tenths, F.lit(10))
    return F.concat(
        indian_number(whole), F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), part.cast("string"))), F.lit(" kg")
    )


def quantity_text(value: Column, unit: Column) -> Column:
    heavy = (value >= 1000) & (unit == "g")
    return F.when(heavy, _kilograms(value)).otherwise(F.concat(indian_number(half_up(value)), F.lit(" "), unit))


def range_text(lo: Column, hi: Column, unit: Column) -> Column:
    return (
        F.when(lo == hi, quantity_text(lo, unit))
        .when((unit == "g") & (hi >= 1000), F.concat(quantity_text(lo, unit), F.lit(" – "), quantity_text(hi, unit)))
        .otherwise(F.concat(indian_number(half_up(lo)), F.lit("–"), quantity_text(hi, unit)))
    )


def weight_comparison(lo: Column, hi: Column, unit: Column) -> Column:
    """Everyday comparison of a weight range in grams."""
    heavier, heavier_g = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, grams in reversed(WEIGHTS):
        heavier = F.when(hi < grams, F.lit(name)).otherwise(heavier)
        heavier_g = F.when(hi < grams, F.lit(float(grams))).otherwise(heavier_g)
    lighter = F.lit(None).cast("string")
    for name, grams in WEIGHTS:
        lighter = F.when(lo > grams, F.lit(name)).otherwise(lighter)
    return (
        F.when(unit != "g", F.lit(""))
        .when(heavier_g <= hi * 3, F.concat(F.lit("Lighter than "), heavier))
        .when(lighter.isNotNull(), F.concat(F.lit("Heavier than "), lighter))
        .otherwise(F.lit(""))
    )


def name_list(names: Column) -> Column:
    """"a, b and c"."""
    n = F.size(names)
    return F.when(n <= 1, F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise(
        F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(names, n - 1))
    )


def month_short(index: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTH_SHORT]), F.pmod(index, F.lit(MONTHS)).cast("int"))


def citation(product: str, what: Column, source: Column, years: Column, generated: str, accessed: str) -> Column:
    """Suggested citation of what a reader looks at; the dates are ISO days."""
    return F.concat(
        F.lit(f"{product} ({accessed[:4]}). "), what, F.lit(". Built from "), source, F.lit(", "), years,
        F.lit(f"; data generated {generated} (accessed {accessed})."),
    )
