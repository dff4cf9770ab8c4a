"""Condition names and keys (S1 to S10), as Column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition_from_name(name: Column, sep: str = "-", drop: int = 1) -> Column:
    """All but the last `drop` pieces; empty if there are no more pieces than that."""
    parts = F.split(name, f"\\Q{sep}\\E")
    keep = F.size(parts) - drop
    return F.when(keep > 0, F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), sep)).otherwise("")


def condition_by_marker(name: Column, marker: str = "-0") -> Column:
    """The text before the first marker."""
    return F.substring_index(name, marker, 1)


def duration(name: Column) -> Column:
    """S3: the last two characters before the first `min`."""
    return F.concat(F.right(F.substring_index(name, "min", 1), F.lit(2)), F.lit(" min"))


def default_rename(name: Column) -> Column:
    """S4."""
    return F.translate(name, "_-", "  ")


def map_rename(name: Column, names: Mapping[str, str], keep: bool = True) -> Column:
    """Exact renaming; other names stay, or become null."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[name], name) if keep else table[name]


def _known(out: Column, name: Column, strict: bool) -> Column:
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown condition: "), name)).cast("string")) if strict else out


def rule_rename(name: Column, cells: Mapping[str, str], targets: Sequence[tuple[str, str]], strict: bool = False, whole: Sequence[str] = (), suffixes: Mapping[str, str] | None = None) -> Column:
    """`<cell prefix><target prefix><suffix>`; cells and targets map prefixes, first match first. Targets in `whole` take no suffix;
    suffixes are replaced by the map. Unknown: null, or an error if strict."""
    out = F.lit(None).cast("string")
    for short, cell in reversed(cells.items()):
        rest = F.substring(name, len(short) + 1, F.length(name))
        own = F.lit(None).cast("string")
        for prefix, target in reversed(targets):
            suffix = F.substring(rest, len(prefix) + 1, F.length(rest))
            suffix = map_rename(suffix, suffixes) if suffixes else suffix
            own = F.when(rest == prefix if prefix in whole else rest.startswith(prefix), F.concat(F.lit(cell + target), suffix)).otherwise(own)
        out = F.when(name.startswith(short), own).otherwise(out)
    return _known(out, name, strict)


def marked_rename(name: Column, targets: Sequence[tuple[str, str]], exact: Mapping[str, str], marker: str, present: str, absent: str, drop: str = " ", repairs: Sequence[tuple[str, str]] = (), strict: bool = False) -> Column:
    """Names in any case, with the characters of `drop` anywhere and a marker or none. The marker becomes the suffix `present`, its absence
    `absent`; repairs replace misspelt parts; what is left is an exact name, or a prefix (first match first) that its target replaces."""
    plain = F.translate(F.upper(name), drop, "")
    rest = F.replace(plain, F.lit(marker), F.lit(""))
    for wrong, right in repairs:
        rest = F.replace(rest, F.lit(wrong), F.lit(right))
    own = F.lit(None).cast("string")
    for prefix, target in reversed(targets):
        own = F.when(rest.startswith(prefix), F.concat(F.lit(target), F.substring(rest, len(prefix) + 1, F.length(rest)))).otherwise(own)
    for short, target in exact.items():
        own = F.when(rest == short, target).otherwise(own)
    return _known(F.concat(own, F.when(plain.contains(marker), present).otherwise(absent)), name, strict)


def decimal_rename(name: Column, prefix: str, target: str, exact: Mapping[str, str] | None = None, strict: bool = False) -> Column:
    """`<prefix, any case><digits>` then `-` or `_` and a number whose first underscore is the decimal point: `<target><digits> <number>`.
    exact: names (any case for lower-case keys) with a name of their own."""
    parts = F.regexp_extract_all(name, F.lit(rf"^(?i:{prefix})(\d*)[-_]([\d_]+)"), F.lit(0))
    digits, raw = F.regexp_extract(name, rf"^(?i:{prefix})(\d*)[-_]([\d_]+)", 1), F.regexp_extract(name, rf"^(?i:{prefix})(\d*)[-_]([\d_]+)", 2)
    whole = F.substring_index(raw, "_", 1)
    fraction = F.replace(F.substring(raw, F.length(whole) + 2, F.length(raw)), F.lit("_"), F.lit(""))
    number = F.when(raw.contains("_"), F.concat(whole, F.lit("."), fraction)).otherwise(raw)
    out = F.when(F.size(parts) > 0, F.concat(F.lit(target), digits, F.lit(" "), number))
    for short, own in (exact or {}).items():
        out = F.when(F.lower(name) == short, own).otherwise(out)
    return _known(out, name, strict)


def joined_rename(name: Column, short: Mapping[str, str], sep: str = "+") -> Column:
    """The parts of a combined name by their abbreviations; names of one part stay."""
    parts = F.transform(F.split(name, f"\\Q{sep}\\E"), lambda part: map_rename(part, short))
    return F.when(name.contains(sep), F.array_join(parts, sep)).otherwise(name)


def substring_rename(name: Column, pairs: Sequence[tuple[str, str]], upper: bool = True) -> Column:
    """Literal replacements in order."""
    for old, new in pairs:
        name = F.replace(name, F.lit(old), F.lit(new))
    return F.upper(name) if upper else name


def letters(n: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA and so on, up to seven letters (8 billion names)."""
    out, left = F.lit(""), n
    for _ in range(7):
        out = F.concat(F.when(left >= 0, F.chr(F.lit(65).cast("long") + F.pmod(left, F.lit(26)))).otherwise(""), out)
        left = F.floor(left / 26) - 1
    return out


def anonymise(df: DataFrame, exceptions: Sequence[str] = (), col: str = "type") -> DataFrame:
    """Adds `label`; exceptions keep their name and use up no letter."""
    names = df.select(col).distinct().filter(F.col(col).isNotNull())
    free = names.filter(~F.col(col).isin(*exceptions)) if exceptions else names
    table = free.withColumn("label", letters(F.row_number().over(Window.orderBy(col)) - 1))
    return df.join(table, col, "left").withColumn("label", F.coalesce("label", col))


def entry_id(sources: Column, extra: Column, size: int = 16) -> Column:
    """A hash of sorted role=path#channel. sources: map role -> (path, channel)."""
    parts = F.transform(F.map_entries(sources), lambda e: F.concat(e["key"], F.lit("="), e["value"]["path"], F.lit("#"), e["value"]["channel"].cast("string")))
    return F.left(F.sha1(F.concat_ws("|", F.array_sort(parts), extra)), F.lit(size))


def parse_polyline(text: Column) -> Column:
    """`x,y x,y` to an array of points."""
    pairs = F.filter(F.split(text, r"\s+"), lambda s: s.contains(","))
    return F.transform(pairs, lambda s: F.struct(F.split(s, ",")[0].try_cast("double").alias("x"), F.split(s, ",")[1].try_cast("double").alias("y")))
