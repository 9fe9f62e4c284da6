"""Native column expressions over the words of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: \x20 and \x09-\x0D
WHITE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def white_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text that is not null."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed (lower() also changes other letters)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def letter_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a lower-cased text that is not null."""
    parts = F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def grams(words: Column, n: int, size: Column) -> Column:
    """Hashes of the runs of n words, as many as there are (`size` is the number of words)."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))
    return F.when(size >= n, F.slice(hashed, 1, size - (n - 1))).otherwise(F.array().cast("array<bigint>"))
