"""Small scalar expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def hue(label: Column) -> Column:
    """A stable colour angle: the sum of the code points times 137, modulo 360."""
    total = F.aggregate(F.transform(F.split(label, ""), F.ascii), F.lit(0), lambda s, x: s + x)
    return F.pmod(total * 137, F.lit(360)).cast("int")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda b: b != ""), lambda b: F.conv(b, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def path_encode(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def csv_items(text: Column) -> Column:
    """The distinct trimmed lower-case items of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def rewrite_prefix(path: Column, prefix: str, local: str) -> Column:
    return F.when(path.startswith(prefix), F.concat(F.lit(local), F.substr(path, F.lit(len(prefix) + 1)))).otherwise(path)


def preview_gain(peak_db: Column) -> Column:
    """Decibels that lift a peak to -1, 30 at most."""
    return F.least(-1 - peak_db, F.lit(30.0))


def mapped(value: Column, mapping: dict[str, str]) -> Column:
    """``value`` through a small mapping; what it lacks stays."""
    if not mapping:
        return value
    table = F.create_map(*(F.lit(x) for pair in sorted(mapping.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, value), value)
