"""Scalar column functions: digests, framed records, sizes, shard paths and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes, binary multiples.
UNITS = {"B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30}


def digest(c: Column) -> Column:
    """Lower-case SHA-256 of a string or binary."""
    return F.sha2(c.cast("binary"), 256)


def record(tag: str, value: Column) -> Column:
    """tag, byte length, the value: no two lists of records make the same text, however the values are split."""
    return F.concat(F.lit(tag + " "), F.octet_length(value).cast("string"), F.lit("\n"), value, F.lit("\n"))


def records(tag: str, values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: record(tag, v)), "")


def human_size(n: Column) -> Column:
    """Binary multiples with two decimals, halves to even."""
    out = F.format_string("%d B", n)
    for unit in ("KB", "MB", "GB"):
        out = F.when(n >= UNITS[unit], F.format_string(f"%.2f {unit}", F.bround(n / float(UNITS[unit]), 2))).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of '64', '10 KB', '3g' and the like, whole numbers in either case; 0 for '', null if it is no size."""
    up = F.upper(F.trim(text))
    number = F.regexp_extract(up, r"^([0-9]+)\s*(KB|MB|GB|K|M|G|B)?$", 1)
    unit = F.regexp_extract(up, r"^([0-9]+)\s*(KB|MB|GB|K|M|G|B)?$", 2)
    scale = F.lit(1)
    for name, n in UNITS.items():
        scale = F.when(unit == name, F.lit(n)).otherwise(scale)
    return F.when(up == "", F.lit(0).cast("long")).when(number != "", number.cast("long") * scale)


def parse_size_text(text: str) -> int:
    """The same for one string, on the driver; ValueError if it is no size."""
    up = text.strip().upper()
    if not up:
        return 0
    for unit in sorted(UNITS, key=len, reverse=True):
        if up.endswith(unit) and up[: -len(unit)].strip().isdigit():
            return int(up[: -len(unit)].strip()) * UNITS[unit]
    if up.isdigit():
        return int(up)
    raise ValueError(f"no size: {text!r}")


def is_name(c: Column) -> Column:
    """May it name a blob or entry? Three or more lower-case hex digits, so no name leaves its folder."""
    return F.coalesce(c.rlike(r"\A[0-9a-f]{3,}\z"), F.lit(False))


def shard_path(c: Column) -> Column:
    """Two-character folder and the rest; null for what is no name."""
    return F.when(is_name(c), F.concat_ws("/", F.substring(c, 1, 2), c.substr(F.lit(3), F.length(c))))


def path_problem(p: Column) -> Column:
    """The first rule that a declared path breaks: empty, absolute, not canonical, escaping; null if none."""
    parts = F.split(p, "/", -1)
    # canonical: no empty or '.' part (but the path '.'), and '..' only at the front
    inner = F.exists(parts, lambda x: (x == "") | (x == ".")) & (p != ".")
    late = F.exists(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (F.get(parts, i) == "..") & (F.get(parts, i - 1) != "..")), lambda x: F.coalesce(x, F.lit(False)))
    return (
        F.when(F.coalesce(p, F.lit("")) == "", F.lit("empty"))
        .when(p.startswith("/"), F.lit("absolute"))
        .when(inner | late, F.lit("not canonical"))
        .when((p == "..") | p.startswith("../"), F.lit("escapes"))
    )


def cached_nodes(line: Column) -> Column:
    """N of the '(N cached)' in a build's last line; null without it."""
    found = F.regexp_extract(line, r"\(([0-9]+) cached\)", 1)
    return F.when(found != "", found.cast("long"))
