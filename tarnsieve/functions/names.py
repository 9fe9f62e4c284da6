"""Column expressions over file names and paths."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What full case folding makes of single characters: those of one character, and those of several."""
    one, several = {}, {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        if (folded := c.casefold()) != c:
            (one if len(folded) == 1 else several)[c] = folded
    return one, several


def casefold(text: Column) -> Column:
    """Full case folding (ß: ss, either small sigma: σ, ligatures: their letters), in the JVM."""
    one, several = _foldings()
    pairs = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(pairs, c), c))
    longer = F.when(text.rlike("[" + "".join(several) + "]"), F.array_join(letters, "")).otherwise(text)
    folded = F.translate(longer, "".join(one), "".join(one.values()))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; leading dots belong to the stem, so `.jpg` has none."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.](?:[\s\S]*?)(\.[^.]*)$", 1))


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs compare as numbers and other text without case: an array that
    begins with a text and then alternates, each entry (digits of the number, text)."""
    runs = F.split(name, r"(?<=[0-9])(?![0-9])|(?<![0-9])(?=[0-9])")
    blank, none = F.array(F.lit("")), F.array().cast("array<string>")
    padded = F.concat(F.when(name.rlike(r"\A[0-9]"), blank).otherwise(none), runs, F.when(name.rlike(r"[0-9]\z"), blank).otherwise(none))

    def entry(text: Column, i: Column) -> Column:
        number = F.regexp_replace(text, r"^0+(?=[0-9])", "")
        odd = i % 2 == 1
        return F.struct(F.when(odd, F.length(number)).otherwise(F.lit(0)).alias("l"), F.when(odd, number).otherwise(casefold(text)).alias("s"))

    return F.transform(padded, entry)


def normalized(path: Column, ignore_case: bool = False) -> Column:
    """A POSIX path without empty, `.` and resolvable `..` parts."""
    lead = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")

    def fold(kept: Column, part: Column) -> Column:
        up = part == ".."
        pops = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return F.when((part == "") | (part == "."), kept).when(up & (F.size(kept) > 0) & F.coalesce(pops, F.lit(False)), F.slice(kept, 1, F.size(kept) - 1)).when(up & (lead != ""), kept).otherwise(F.array_append(kept, part))

    # element_at of an empty array would fail, so `..` looks at it behind a guard
    def guarded(kept: Column, part: Column) -> Column:
        return F.when(F.size(kept) == 0, F.when((part == "") | (part == ".") | ((part == "..") & (lead != "")), kept).otherwise(F.array(part))).otherwise(fold(kept, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), guarded)
    joined = F.concat(lead, F.array_join(parts, "/"))
    clean = F.when(joined == "", ".").otherwise(joined)
    return F.lower(clean) if ignore_case else clean


def ancestors(path: Column) -> Column:
    """A normalized path's own text and its proper ancestors below the root, e.g. /a/b: [/a, /a/b]."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    lead = F.regexp_extract(path, "^(/*)", 1)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(lead, F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(F.size(parts) > 0, cut).otherwise(F.array(path))


def matches(query: str, *columns: Column) -> Column:
    """Search: the stripped lower-case query is a literal part of the columns' text, joined by spaces; an empty one matches all."""
    wanted = query.strip().lower()
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted)) if wanted else F.lit(True)
