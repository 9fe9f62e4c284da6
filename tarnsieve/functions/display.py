"""Column expressions for what a person reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last second that a calendar of years 1 to 9999 has.
_FIRST, _LAST = -62135596800, 253402300799


def size_text(size: Column) -> Column:
    """Bytes in steps of 1024: whole bytes, else one decimal, ties to even; the unit is chosen before rounding."""
    # The names of the units.
    text = None
    scaled = size.cast("double")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        below = scaled < 1024
        said = F.concat(size.cast("long").cast("string"), F.lit(" B")) if k == 0 else F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(f" {unit}"))
        text = (F if text is None else text).when(below, said)
        scaled = scaled / 1024
    return text.otherwise(F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(" PB")))


def time_text(seconds: Column) -> Column:
    """Local time of the session's zone to the second; `-` for none or zero; other numbers as they are."""
    known = F.date_format(F.timestamp_seconds(F.round(seconds, 6)), "yyyy-MM-dd HH:mm:ss")
    return F.when(seconds.isNull() | (seconds == 0), "-").when(seconds.between(_FIRST, _LAST), known).otherwise(seconds.cast("string"))


def group_header(n: Column, size: Column) -> Column:
    # The words of the header.
    return F.concat(F.lit("Exact duplicates — "), n.cast("string"), F.lit(" files, "), size_text(size), F.lit(" each"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def detail_text(row: dict[str, Column]) -> Column:
    """The record of one file, a labelled line for each field; a warning follows if it has an error."""
    # The labels and what stands for a missing hash.
    missing = F.lit("(not computed)")
    shown = [
        ("Name:          ", row["name"]),
        ("Folder:        ", row["dir"]),
        ("Full path:     ", row["path"]),
        ("Category:      ", row["category"]),
        ("Size:          ", size_text(F.coalesce(row["size"], F.lit(0)))),
        ("Modified:      ", time_text(row["mtime"])),
        ("Created (fs):  ", time_text(row["ctime"])),
        ("", F.lit("")),
        ("Full hash:     ", F.coalesce(F.when(row["full_hash"] != "", row["full_hash"]), missing)),
        ("Partial hash:  ", F.coalesce(F.when(row["partial_hash"] != "", row["partial_hash"]), missing)),
    ]
    lines = [F.concat(F.lit(label), F.coalesce(value, F.lit("None"))) for label, value in shown]
    warning = F.when(row["error"] != "", F.concat(F.lit("\n\nWarning: "), row["error"])).otherwise(F.lit(""))
    return F.concat(F.concat_ws("\n", *lines), F.coalesce(warning, F.lit("")))
