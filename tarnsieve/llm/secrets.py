"""Secret scans: patterns of known shapes, and a battery of randomness tests for other tokens.

Base kinds (assign, access, hex) are leftmost non-overlapping matches of their patterns which pass
their length check; they are always reported.  Kind `random` is added for runs of 20 or more
token characters, however long, that overlap no base span and pass the battery:

* the encoding is inferred from the characters (hex in one case, base32, base36, base62, base64 of
  either sign pair, or all of these mixed), without `=` at the end; a run that is the base64 of a UTF-8 text (as keys
  in configuration files are) is judged by every run of 20 or more in that text, and found if one of them is; runs of
  letters alone in one case, of digits alone, or of one class of characters are no candidates;
* chi-squared uniformity over that alphabet: how likely characters distributed as in natural words
  and identifiers would look as uniform as the token does (their sum of squared shares and its
  spread give the null distribution; its distance from the uniform one grows with the length);
  from 8 characters a letter on, letters with under a quarter of their share are not in use;
* for base32, base36 and upper-case hex, where uniformity of 20 to 40 characters says little, in its place how
  likely words have letter pairs as rare as the token's, or (hex) letters of A to F only;
* class changes (lower case, upper case, digit, sign): how likely an identifier would change as often;
* equal pairs of characters (chi-squared, with the skewness that few characters over many letters have), runs
  above and below the middle of the alphabet, and serial correlation of neighbouring ranks: how likely random
  characters would be as uneven, or a sequence such as abc..., 0123... or a repeated pattern as orderly;
* Fisher's method combines the tests against natural origin into one p-value, those against randomness into
  another.  The Benjamini-Hochberg rule over all candidates of the corpus is used on both: it dismisses tokens that
  aren't random, at most `false_dismissals` of them wrongly, and then, with weight 0 for those (they still count among
  the candidates), bounds the share of false discoveries.  All distributions are those of the token's length.
  Ranks are counted in histograms of log p-values, so the rule costs two small aggregates.

All expressions are native.  Positions come from the gaps between matches (split) and the matches
themselves; texts without a literal that a pattern needs are not searched.

Nulls and ties: a null text is an empty one; a null id is kept; repeated rows are scanned as often as
they occur; other columns are ignored; an empty table gives no rows.  Positions are code points,
ends exclusive.  Very long texts are searched whole; running sums in blocks keep the work for their many
matches near linear.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{14,}"
_HEX = r"[0-9a-f]{16,}"
_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_SPANS = "array<struct<start:int,kind:int,end:int>>"

#: Numbers that are summed one by one, from the start of their block.
_BLOCK = 128

_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

# Fixed values for each encoding: name, alphabet in order, pattern of the whole token, and for
# characters of natural words and identifiers written in it: sum of squared and of cubed shares.
ENCODINGS = (
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$", 0.15, 0.03),
    ("HEX", "0123456789ABCDEF", r"^[0-9A-F]+$", 0.15, 0.03),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$", 0.066, 0.0058),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[a-z0-9]+$", 0.066, 0.0058),
    ("base62", _LETTERS, r"^[A-Za-z0-9]+$", 0.06, 0.005),
    ("base64", _LETTERS + "+/", r"^[A-Za-z0-9+/]+=*$", 0.06, 0.005),
    ("base64url", _LETTERS + "-_", r"^[A-Za-z0-9_-]+=*$", 0.06, 0.005),
    ("mixed", _LETTERS + "+/-_=", r"^.*$", 0.06, 0.005),
)
#: Share of neighbours of different class in natural identifiers.
_CHANGE = 0.15
# 4 log2 of a letter pair's share in words and identifiers (four languages and program text)
# against that of random letters; a row for each first letter, a to z, a number for each second.
_PAIRS = (
    (-3, -2, 2, 0, -6, -12, -4, -11, 1, -20, -9, 5, 0, 8, -9, -3, -18, 5, 6, 8, 1, -10, -10, -11, -9, -19),  # a
    (6, -3, 0, -6, 9, -9, -13, -12, 0, -1, -15, 11, -10, -10, 4, -7, -15, -2, -2, -8, 3, -17, -14, -14, 2, -14),  # b
    (5, -12, -6, -8, 5, -9, -15, 10, 4, -20, 3, 3, -8, -14, 8, -11, -18, -1, -6, 5, -3, -12, -16, -19, -8, -20),  # c
    (4, -5, -6, -2, 13, -7, -10, -5, 7, -16, -17, -1, -10, -5, 6, -9, -18, -2, 0, -1, -1, -14, -8, -15, -11, -19),  # d
    (3, -9, 0, 3, -1, -3, -10, -10, -1, -20, -17, 3, -4, 7, -6, -5, -5, 10, 7, 2, -8, -8, -9, -1, -12, -13),  # e
    (5, -7, -5, -3, 3, 5, -7, -11, 9, -15, -15, 1, -10, -6, 9, -9, -17, 5, -3, 0, 2, -14, -13, -16, -8, -15),  # f
    (4, -6, -7, -9, 12, -9, -2, 2, 3, -16, -12, 0, -6, 1, 0, -7, -17, 3, 5, 0, -1, -8, -9, -16, -13, -9),  # g
    (9, -5, -10, -14, 13, -18, -13, -1, 3, -20, -12, -4, -13, -2, 4, -12, -20, -2, -1, 3, -8, -13, -6, -20, -15, -14),  # h
    (-4, -6, 2, -3, 3, -3, -3, -15, -11, -19, -16, 1, -1, 12, 6, -4, -17, -3, 4, 6, -19, -7, -19, -9, -20, -6),  # i
    (10, -6, -4, -4, 9, -7, -6, -5, -1, -6, -1, -5, -6, -6, 5, -2, -6, -6, 1, -6, 4, -7, -6, -7, -5, -7),  # j
    (1, -7, -3, -5, 14, -6, -3, -7, 5, -8, -10, 2, -9, -3, -5, -5, -11, -4, 3, -2, -5, -9, -1, -13, -7, -12),  # k
    (5, -12, -10, -3, 12, 6, -16, -17, 6, -20, -17, 4, -12, -14, 4, -8, -20, -13, -1, -1, -2, -15, -17, -20, 5, -18),  # l
    (8, -2, -12, -8, 12, -11, -15, -15, 5, -19, -13, -4, -2, -9, 5, 6, -17, -12, 0, -6, -2, -14, -14, -19, -4, -17),  # m
    (3, -6, 0, 7, 6, -6, 7, -4, 1, -19, -9, -4, -11, -3, 4, -9, -15, -6, 3, 9, -6, -7, -9, -20, -15, -16),  # n
    (-7, -5, 0, 1, -12, 2, -8, -19, -3, -18, -9, -2, 0, 12, -3, -1, -20, 9, 0, 0, 6, -9, -4, -11, -20, -18),  # o
    (9, -13, -7, -7, 8, 0, -13, -6, 2, -20, -12, 4, -13, -12, 5, 1, -14, 6, -3, 4, -3, -13, -13, -20, 1, -19),  # p
    (-7, -9, -10, -11, -10, -11, -10, -11, -9, -13, -10, -4, -10, -8, -11, -9, -7, -6, -6, -8, 17, -9, -10, -11, -11, -12),  # q
    (5, -7, -4, -5, 12, -11, -4, -6, 4, -20, -9, -5, -4, -1, 5, -9, -20, 2, 2, 5, -3, -9, -9, -20, -5, -17),  # r
    (-3, -12, 1, -11, 11, -14, -9, 4, 2, -18, -9, -6, -8, -9, -1, -2, -13, -9, 5, 11, 0, -17, -11, -20, -6, -20),  # s
    (3, -10, -5, -10, 9, -9, -16, 11, 8, -20, -16, -7, -10, -8, 2, -7, -20, 3, 0, -1, -3, -15, -10, -19, -3, -8),  # t
    (3, 0, -4, -8, 8, -4, -7, -11, -1, -20, -16, 3, 0, 8, -4, 1, -15, 5, 2, 5, -14, -12, -15, 2, -20, -16),  # u
    (9, -8, -8, -11, 14, -10, -11, -10, 8, -14, -14, -10, -6, -10, 0, -11, -14, -9, -9, -9, -12, -13, -10, -14, -9, -11),  # v
    (7, -10, -8, -6, 2, -10, -13, 12, 10, -15, -15, -6, -11, 0, 2, -11, -16, 2, -1, -10, -12, -11, -8, -10, -16, -16),  # w
    (3, -3, 7, -3, 8, 2, -13, -8, 3, -10, -12, -5, -2, -9, -3, 4, -8, -4, -6, 9, -11, -8, -11, 2, -2, -11),  # x
    (-1, -3, -2, -5, 3, -5, -8, -3, 1, -14, -12, 1, -2, 3, 1, 8, -12, -2, 6, 7, -8, -7, -2, -8, 0, -6),  # y
    (2, -5, -4, -6, 10, -8, -5, -6, 4, -9, -8, -5, -4, -10, -1, -5, -9, -8, -4, -5, 10, -8, -8, -6, -6, 7),  # z
)
#: Mean log2 of a pair in natural tokens of 20 letters or more, and its spread (as if pairs were independent).
_PAIR_MEAN, _PAIR_SPREAD = 0.95, 1.7
#: Share of A to F among the letters of natural words.
_HEX_LETTERS = 0.32
#: Encodings of one case, by place in ENCODINGS: their letters are judged as words.
_UPPER_HEX, _ONE_CASE = 1, (2, 3)
#: A character of another class than the one before.
_CHANGED = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[+/_=-])[A-Za-z0-9]"


def _normal_below(z: Column) -> Column:
    """P(Z <= z) of the normal distribution, by a rational approximation (error below 1e-7; Abramowitz and Stegun 26.2.17),
    beyond 3 by the continued fraction of the tail (26.2.14), whose relative error is small there."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    near = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = 1 / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 5 / (x + 6 / (x + 1)))))))
    tail = F.exp(-x * x / 2) / sqrt(6.283185307179586) * F.when(x > 3, far).otherwise(near)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _running(df: DataFrame, numbers: str, name: str) -> DataFrame:
    """df with `name`: the sums of the array `numbers` up to and with each element.  Blocks are summed, then the
    elements of each block from its block's start, since an array that grows by one is copied each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda k: F.slice(numbers, k * _BLOCK + 1, _BLOCK))
    cut = df.withColumn("_blocks", F.when(F.size(numbers) > 0, blocks).otherwise(F.array().cast("array<array<int>>")))

    def sums(array, start, add):
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(array, state, lambda s, x: F.struct((s["at"] + add(x)).alias("at"), F.array_append(s["sums"], s["at"] + add(x)).alias("sums")), lambda s: s["sums"])

    whole = cut.withColumn("_ends", sums("_blocks", F.lit(0), lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)))
    starts = whole.withColumn("_starts", F.concat(F.array(F.lit(0)), "_ends"))
    return starts.withColumn(name, F.flatten(F.zip_with("_blocks", F.slice("_starts", 1, F.size("_blocks")), lambda b, at: sums(b, at, lambda x: x)))).drop("_blocks", "_ends", "_starts")


def _places(df: DataFrame, wanted: Column, pattern: str, name: str) -> DataFrame:
    """Adds the matches of a pattern: `name`, an array of (m, start, end).  Not searched unless wanted."""
    none = F.array().cast("array<string>")
    found = df.withColumns({"_m": F.when(wanted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none), "_gaps": F.when(wanted, F.split("text", pattern)).otherwise(none)})
    lengths = F.zip_with(F.slice("_gaps", 1, F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m))
    placed = _running(found.withColumn("_lengths", lengths), "_lengths", "_at")
    joined = F.zip_with("_m", "_at", lambda m, at: F.struct(m.alias("m"), (at - F.length(m)).alias("start"), at.alias("end")))
    return placed.withColumn(name, joined).drop("_m", "_gaps", "_lengths", "_at")


def _apart(df: DataFrame, tokens: str, spans: str, name: str) -> DataFrame:
    """df with `name`: for each token (in order, none overlapping another) whether it overlaps none of the spans.  A token overlaps one if more spans begin before its end than end before or at its start; both are running
    counts over the ends of all, sorted."""
    # at equal positions: a span's end counts before a token's start, a token's end before a span's start
    def events(column, at, order, more):
        return F.transform(column, lambda x: F.struct(x[at].alias("at"), F.lit(order).alias("order"), F.lit(more).alias("more")))

    both = (F.size(tokens) > 0) & (F.size(spans) > 0)
    sorted_ = F.sort_array(F.concat(events(spans, "end", 0, 0), events(tokens, "start", 1, 0), events(tokens, "end", 2, 0), events(spans, "start", 3, 1)))
    counted = df.withColumn("_events", F.when(both, sorted_).otherwise(F.array().cast("array<struct<at:int,order:int,more:int>>")))
    begun = _running(counted.withColumn("_n", F.transform("_events", lambda e: e["more"])), "_n", "_begun")
    ended = _running(begun.withColumn("_n", F.transform("_events", lambda e: (e["order"] == 0).cast("int"))), "_n", "_ended")
    paired = ended.withColumn("_events", F.zip_with("_events", F.arrays_zip("_begun", "_ended"), lambda e, c: F.struct(e["order"].alias("order"), c["_begun"].alias("begun"), c["_ended"].alias("ended"))))
    at_start = F.transform(F.filter("_events", lambda e: e["order"] == 1), lambda e: e["ended"])
    at_end = F.transform(F.filter("_events", lambda e: e["order"] == 2), lambda e: e["begun"])
    apart = F.when(both, F.zip_with(at_start, at_end, lambda ended, begun: begun <= ended)).otherwise(F.transform(tokens, lambda _: F.lit(True)))
    return paired.withColumn(name, apart).drop("_events", "_n", "_begun", "_ended")


def _spans(column: str, kind: int) -> Column:
    return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _runs(token: Column) -> Column:
    """What is judged of a token: the runs in the UTF-8 text that it is the base64 of, else the token itself.  Text has
    no control characters but tabs and line breaks, which so many random bytes hardly ever lack."""
    bare = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)).cast("int")))
    data = F.when(token.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)={0,2}$") & (F.length(bare) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    plain = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    text = F.when(~plain.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), plain)
    return F.coalesce(F.regexp_extract_all(F.regexp_replace(text, r"[\r\n]", ""), F.lit(_TOKEN), F.lit(0)), F.array(token))


def _candidate(token: Column) -> Column:
    """Not of one class of characters, nor without a digit or capital."""
    return ~token.rlike(r"^([a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+)$") & token.rlike("[0-9A-Z]")


def _battery(tokens: DataFrame) -> DataFrame:
    """tokens (m, ...): adds encoding, p (of natural origin) and p_random (of random characters)."""
    encoding = alphabet = squared = cubed = None
    for k, (_, letters, pattern, s2, s3) in enumerate(ENCODINGS):
        fits = F.col("m").rlike(pattern)
        encoding = (F if encoding is None else encoding).when(fits, k)
        alphabet = (F if alphabet is None else alphabet).when(fits, letters)
        squared = (F if squared is None else squared).when(fits, s2)
        cubed = (F if cubed is None else cubed).when(fits, s3)
    step1 = tokens.withColumns({"encoding": encoding, "alphabet": alphabet, "s2": squared, "s3": cubed, "core": F.when(F.col("m").rlike("[^=].{14,}[^=]=*$"), F.regexp_replace("m", "=+$", "")).otherwise(F.col("m"))})
    letters = F.filter(F.split("alphabet", ""), lambda c: c != "")
    # a pass over the token for each letter: linear in its length
    counts = F.transform(letters, lambda c: (F.length("core") - F.length(F.replace(F.col("core"), c, F.lit("")))).cast("double"))
    ranks = F.transform(F.filter(F.split("core", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c) - 1)
    step2 = step1.withColumns({"n": F.length("core").cast("double"), "size": F.length("alphabet").cast("double"), "counts": counts, "ranks": ranks})
    n, size, middle = F.col("n"), F.col("size"), (F.col("size") - 1) / 2

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)

    def neighbours(column: str, say) -> Column:
        """Sum of say(x, next) over neighbours."""
        return total(F.transform(F.slice(column, 1, F.size(column) - 1), lambda x, i: say(x, F.get(column, i + 1)).cast("double")))

    used = F.filter("counts", lambda v: (n < 8 * size) | (v >= n / (4 * size)))
    # of neighbouring letters; null if one is none
    places = F.transform("ranks", lambda r: F.instr(F.lit(_ALPHABET), F.lower(F.substring("alphabet", r + 1, F.lit(1)))))
    table = F.array(*(F.lit(v) for row in _PAIRS for v in row))
    scores = F.transform(F.slice("places", 1, F.size("places") - 1), lambda a, i: F.when((a > 0) & (F.get("places", i + 1) > 0), F.get(table, (a - 1) * 26 + F.get("places", i + 1) - 1)))
    one_case = F.when(F.col("encoding").isin(*_ONE_CASE), places).otherwise(F.array().cast("array<int>"))
    step3 = step2.withColumns({"used": used, "places": one_case}).withColumn("scores", F.when(F.size("places") > 1, scores).otherwise(F.array().cast("array<int>"))).withColumns({
        "equal": total(F.transform("counts", lambda v: v * v)),
        "used_n": total(F.col("used")),
        "used_equal": total(F.transform("used", lambda v: v * v)),
        "used_size": F.size("used").cast("double"),
        "pairs": total(F.transform("scores", lambda v: v.isNotNull().cast("double"))),
        "pair_score": total(F.transform("scores", lambda v: F.coalesce(v / 4.0, F.lit(0.0)))),
        "changes": F.regexp_count("core", F.lit(_CHANGED)).cast("double"),
        "above": total(F.transform("counts", lambda v, i: F.when(i > middle, v).otherwise(F.lit(0.0)))),
        "crossings": neighbours("ranks", lambda a, b: (a > middle) != (b > middle)),
        "product": neighbours("ranks", lambda a, b: (a - middle) * (b - middle)),
        "square": total(F.transform("counts", lambda v, i: v * (i - middle) * (i - middle))),
    })
    # each step's columns are used several times in the next, so they are made once
    s2, s3, pairs, q, used_n = F.col("s2"), F.col("s3"), F.col("pairs"), 1 / F.col("used_size"), F.col("used_n")
    twos = used_n * (used_n - 1) / 2
    step4 = step3.withColumns({
        "natural_spread": F.sqrt(2 * n * (n - 1) * (s2 - s2 * s2) + 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2)),
        "spread": twos * q * (1 - q),
        "third": twos * q * (1 - q) * (1 - 2 * q + 2 * (used_n - 2) * q),
        "expected": 1 + 2 * F.col("above") * (n - F.col("above")) / n,
    })
    # chi-squared against even shares as the number of equal pairs, by a gamma distribution of its three moments
    step5 = step4.withColumns({"shape": 4 * F.pow("spread", F.lit(3.0)) / (F.col("third") * F.col("third")), "variance": (F.col("expected") - 1) * (F.col("expected") - 2) / (n - 1)})
    shape = F.col("shape")
    gamma = 1 + ((F.col("used_equal") - used_n - 1) / 2 - twos * q) / F.sqrt("spread") / F.sqrt(shape)
    step6 = step5.withColumns({
        "z_equal": (F.col("equal") - n - n * (n - 1) * s2) / F.col("natural_spread"),
        "z_changes": (F.col("changes") - 0.5 - (n - 1) * _CHANGE) / F.sqrt((n - 1) * _CHANGE * (1 - _CHANGE)),
        "z_pairs": (F.col("pair_score") - pairs * _PAIR_MEAN) / (_PAIR_SPREAD * F.sqrt(F.greatest("pairs", F.lit(1.0)))),
        "z_runs": -F.abs(F.col("crossings") + 1 - F.col("expected")) / F.sqrt("variance"),
        "z_serial": -F.abs(F.col("product") / F.col("square")) * F.sqrt(n),
        # Wilson and Hilferty
        "z_even": (F.cbrt(F.greatest(gamma, F.lit(0.0))) - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape),
    })
    least = F.lit(1e-30)
    # one case: letters against those of words
    one_case = F.when(F.col("encoding") == _UPPER_HEX, F.pow(F.lit(_HEX_LETTERS), F.regexp_count("core", F.lit("[A-F]")).cast("double")))
    one_case = one_case.when(F.col("encoding").isin(*_ONE_CASE), F.when(pairs > 0, _normal_below(F.col("z_pairs"))).otherwise(F.lit(1.0)))
    step7 = step6.withColumns({
        "p_uniform": F.greatest(one_case.otherwise(_normal_below(F.col("z_equal"))), least),
        "p_changes": F.greatest(1 - _normal_below(F.col("z_changes")), least),
        "p_runs": F.when(F.col("variance") > 0, F.greatest(2 * _normal_below(F.col("z_runs")), least)).otherwise(least),
        "p_serial": F.when(F.col("square") > 0, F.greatest(2 * _normal_below(F.col("z_serial")), least)).otherwise(least),
        "p_even": F.when((F.col("used_size") > 1) & (used_n > 2), F.greatest(_normal_below(-F.col("z_even")), least)).otherwise(least),
    })
    step8 = step7.withColumns({"half": -(F.log("p_uniform") + F.log("p_changes")), "half_random": -(F.log("p_runs") + F.log("p_serial") + F.log("p_even"))})
    half, other = F.col("half"), F.col("half_random")
    # chi-squared with 4 and with 6 degrees of freedom
    combined, p_random = F.exp(-half) * (1 + half), F.exp(-other) * (1 + other + other * other / 2)
    return step8.select("m", "start", "end", *[c for c in tokens.columns if c not in ("m", "start", "end")], "encoding", combined.alias("p"), p_random.alias("p_random"))


def _bin(p: str) -> Column:
    return F.floor(-F.log10(p) * 20).cast("int")


def _passing(tested: DataFrame, p: str, share: float, total: int) -> Column:
    """Whether the Benjamini-Hochberg rule rejects, by the histogram of the rows' p-values among `total` tests."""
    bins = tested.groupBy(_bin(p).alias("bin")).count().collect()  # at most some 1800 bins
    rank, cut = 0, None
    for b in sorted(bins, key=lambda b: -b["bin"]):
        rank += b["count"]
        if 10 ** (-b["bin"] / 20) * total <= share * rank:
            cut = b["bin"]
    return F.lit(False) if cut is None else _bin(p) >= cut


def find_secrets(documents: DataFrame, false_discoveries: float = 0.0001, id_col: str = "doc_id", text_col: str = "text", false_dismissals: float = 0.001) -> DataFrame:
    """doc_id and its spans: an array of (start, kind, end), in that order; kind 3 is `random`."""
    with scratch(documents.sparkSession) as keep:
        result = written(_found(documents, false_discoveries, false_dismissals, id_col, text_col), "secret-spans")
        keep(result)
    return result


def _found(documents: DataFrame, false_discoveries: float, false_dismissals: float, id_col: str, text_col: str) -> DataFrame:
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lowered = docs.withColumn("_low", F.lower("text"))
    keyed = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        keyed = keyed | F.col("_low").contains(word)
    flagged = lowered.withColumns({"_keyed": keyed, "_akia": F.col("text").contains("AKIA"), "_hexed": F.col("text").rlike(_HEX), "_long": F.col("text").rlike(_TOKEN)}).drop("_low")
    some = F.col("_keyed") | F.col("_akia") | F.col("_hexed") | F.col("_long")
    # texts with nothing to find go no further
    slim = flagged.withColumn("text", F.when(some, F.col("text")).otherwise(F.lit("")))
    found = _places(slim, F.col("_keyed"), _ASSIGN, "assign")
    found = found.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], _ASSIGN, 2)) >= 12))
    found = _places(found, F.col("_akia"), _ACCESS, "access")
    found = _places(found, F.col("_hexed"), _HEX, "hex")
    found = _places(found, F.col("_long"), _TOKEN, "tokens")
    base = found.withColumn("base", F.sort_array(F.concat(*(_spans(k, i) for i, k in enumerate(BASE_KINDS)))))
    told = _apart(base, "tokens", "base", "_apart")
    free = F.transform(F.filter(F.arrays_zip("tokens", "_apart"), lambda x: x["_apart"]), lambda x: x["tokens"])
    mixed = F.filter(free, lambda x: _candidate(x["m"]))
    scanned = written(told.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", mixed.alias("tokens")), "secrets")
    tokens = scanned.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", F.explode(_runs(F.col("t.m"))).alias("m"), "t.start", "t.end")
    tested = written(_battery(tokens.where(_candidate(F.col("m")))), "battery")
    total = tested.count()
    left = tested.where(~_passing(tested, "p_random", false_dismissals, total))
    left = left.where(_passing(left, "p", false_discoveries, total))
    random = left.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(BASE_KINDS)).alias("kind"), "end")).alias("random"))
    every = F.sort_array(F.concat("base", F.coalesce("random", F.array().cast(_SPANS))))
    return scanned.join(random, "row", "left").select("doc_id", every.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    names = F.array(*map(F.lit, (*BASE_KINDS, "random")))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE_KINDS[kind]}")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select("doc_id", *map(count, range(len(BASE_KINDS))), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
