"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

A conversation's rows are taken by turn (nulls first), rows of one turn by role, then by the MD5 of their text.  Each
row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (the
last character that isn't white is none of `.!?`).  Edits: Keep (0), Rerole to user or assistant (1), Delete (2; required
for blank and duplicate rows), Insert an empty user or assistant row anywhere (5); a truncated row that
isn't deleted costs 5 more.  Of the cheapest edits those whose initials are least in ASCII order are taken.

1. Spark finds the (conversation, role, text digest) groups with several rows and their first turns; rows come sorted by
   conversation and turn, without texts, and a worker makes of each conversation its signature: a
   character a row, for its role's initial and its fault.
2. Signatures are dealt out by range and sorted, so that a worker meets them in the order of a prefix trie: it keeps the
   layers of the path to the last one, goes back to the common prefix and adds a layer of the dynamic programme (least
   cost for each state of the grammar) for each new character.  Equal prefixes are thus worked out once, and equal
   signatures answered once; answers are read off at the end of a signature, backward for the states on some
   cheapest way and forward for the least initials.
3. Audits meet the rows again in their order, and a worker streams the repaired rows, their texts and their hash.

State held by a worker: a byte a row and 33 a row of the longest signature; texts are streamed.  A conversation may
hold any share of the rows; its signature, audit and hash are one value each, so those are made in one task, row by
row.  Signatures that many conversations share are dealt out by conversation too.

Nulls and ties: null roles and texts are one space (a null turn too where it names the row); rows without a conversation id are
one conversation; equal rows are duplicates of the first; a role whose initial isn't s, u or a (or an empty role) can't be
kept.  An empty table gives no rows; other columns are ignored.  Long texts are hashed whole.
"""

from __future__ import annotations

from array import array
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

_MANY = 1 << 60
#: States: nothing yet, after system, after user, after assistant.  The role that may be put next, and the states by initial.
_NEXT = (2, 2, 3, 2)
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_ENDS = (0, 3)
_ROLE = {2: "user", 3: "assistant"}
_VISIBLE = r"[^\x20\x09-\x0D]"


def _filled(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present of the rows after damage by crc32(`conv_id:turn`) % 20: 0 drops the row
    (it is not present, but names its conversation), 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes it a user's."""
    kind = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_filled("text"), ".!?", "")).otherwise(_filled("text"))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(_filled("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("_", "times")


# ---- signatures


def _characters(role: Column) -> Column:
    """s, u, a or x."""
    initial = F.substring(role, 1, 1)
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("x")


def _signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, signature (lower case; upper case: truncated; `-`: has to go), gaps and
    the numbers of faults."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    # groups with several rows, and the turn of the first
    several = keyed.where("present").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
    slim = keyed.select(
        "conv_id", "turn", "role", "digest", "present", _characters(F.col("role")).alias("initial"),
        (~F.col("text").rlike(_VISIBLE)).alias("blank"),
        (~F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    named = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("conv_id", "role", "digest")]
    flagged = slim.alias("r").join(several.alias("s"), named[0] & named[1] & named[2], "left").select("r.*", (F.col("s.n").isNotNull() & ~F.col("s.first").eqNullSafe(F.struct(F.col("r.turn").isNotNull().alias("known"), F.col("r.turn").alias("turn")))).alias("later"))
    kind = dict(rows.dtypes)["conv_id"]

    def sign(batches):
        def each():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "present", "initial", "blank", "cut", "later")))

        out = []
        for conv, some in groupby(each(), key=lambda r: r[0]):
            signature, blank, duplicate, truncated, illegal = bytearray(), 0, 0, 0, 0
            low = high = None
            turns, last, before = 0, None, None
            for _, turn, role, digest, present, initial, empty, cut, later in some:
                if not present:
                    continue
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != high
                    high = turn
                same, last = (turn, role, digest) == last, (turn, role, digest)
                if empty:
                    blank, mark = blank + 1, "-"
                elif later or same:
                    duplicate, mark = duplicate + 1, "-"
                elif cut:
                    truncated, mark = truncated + 1, initial.upper()
                else:
                    mark = initial
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                signature += mark.encode()
            out.append((conv, signature.decode(), 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal))
            if len(out) == 5000:
                yield _table(out, conv_type, _SIGNED)
                out = []
        if out:
            yield _table(out, conv_type, _SIGNED)

    conv_type = _arrow_type(rows, "conv_id")
    ordered = flagged.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.mapInArrow(sign, f"conv_id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


_L = pa.int64()
_SIGNED = (("signature", pa.string()), ("gaps", _L), ("blank", _L), ("duplicate", _L), ("truncated", _L), ("illegal", _L))


def _arrow_type(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _table(rows: list[tuple], conv_type, columns) -> pa.RecordBatch:
    arrays = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(arrays[0], conv_type), *(pa.array(a, t) for a, (_, t) in zip(arrays[1:], columns))], names=["conv_id", *(n for n, _ in columns)])


# ---- the trie of signatures


def _closed(layer: list[int]) -> list[int]:
    """The costs of a layer with rows inserted: at most two, as the grammar's cycle has two states."""
    for _ in range(2):
        for state, cost in enumerate(layer):
            if cost + 5 < layer[_NEXT[state]]:
                layer[_NEXT[state]] = cost + 5
    return layer


def _moves(mark: str):
    """(initial, cost, target of each state) of what can be done with a row, in ASCII order."""
    found = [("D", 2, (0, 1, 2, 3))]
    if mark != "-":
        extra = 5 if mark.isupper() else 0
        if mark.lower() in _KEEP:
            found.append(("K", extra, _KEEP[mark.lower()]))
        found.append(("R", 1 + extra, _NEXT))
    return found


_MOVES = {mark: _moves(mark) for mark in "suaxSUAX-"}


class Trie:
    """The path of a prefix trie to the signature last asked for: four costs a layer, kept for what shares the prefix."""

    def __init__(self):
        self.signature = ""
        self.costs = array("q", _closed([0, _MANY, _MANY, _MANY]))
        self.layers_made = 0

    def _to(self, signature: str) -> None:
        common, most = 0, min(len(signature), len(self.signature))
        if signature[:most] == self.signature[:most]:
            common = most
        else:
            low, high = 0, most  # the first difference, by halves
            while low < high:
                middle = (low + high) // 2
                if signature[: middle + 1] == self.signature[: middle + 1]:
                    low = middle + 1
                else:
                    high = middle
            common = low
        del self.costs[4 * (common + 1) :]
        last = self.costs[4 * common : 4 * common + 4]
        for mark in signature[common:]:
            layer = [_MANY] * 4
            for _, cost, targets in _MOVES[mark]:
                for state in range(4):
                    to = targets[state]
                    if to is not None and last[state] + cost < layer[to]:
                        layer[to] = last[state] + cost
            last = _closed(layer)
            self.costs.extend(last)
            self.layers_made += 1
        self.signature = signature

    def answer(self, signature: str) -> tuple[int, str]:
        """(least cost, audit)."""
        self._to(signature)
        costs, n = self.costs, len(signature)
        least = min(costs[4 * n + e] for e in _ENDS)
        # bit q of on[i]: state q after i rows lies on a cheapest way
        on = bytearray(n + 1)
        on[n] = sum(1 << e for e in _ENDS if costs[4 * n + e] == least)
        for i in range(n, -1, -1):
            here = on[i]
            for _ in range(2):
                for state in range(4):
                    if here >> _NEXT[state] & 1 and costs[4 * i + state] + 5 == costs[4 * i + _NEXT[state]]:
                        here |= 1 << state
            on[i] = here
            if i:
                before = 0
                for _, cost, targets in _MOVES[signature[i - 1]]:
                    for state in range(4):
                        to = targets[state]
                        if to is not None and here >> to & 1 and costs[4 * i - 4 + state] + cost == costs[4 * i + to]:
                            before |= 1 << state
                on[i - 1] = before
        said, i, state = bytearray(), 0, 0
        while i < n or state not in _ENDS or costs[4 * n + state] != least:
            here = costs[4 * i + state]
            insert = on[i] >> _NEXT[state] & 1 and here + 5 == costs[4 * i + _NEXT[state]]
            step = None
            for letter, cost, targets in _MOVES[signature[i]] if i < n else ():
                to = targets[state]
                if to is not None and on[i + 1] >> to & 1 and here + cost == costs[4 * i + 4 + to]:
                    step = (letter, i + 1, to)
                    break
            if insert and (step is None or step[0] > "I"):
                step = ("I", i, _NEXT[state])
            letter, i, state = step
            said += letter.encode()
        return least, said.decode()


def _audited(signed: DataFrame) -> DataFrame:
    """Signatures with cost and audit."""
    kind, conv_type = dict(signed.dtypes)["conv_id"], _arrow_type(signed, "conv_id")
    columns = (*_SIGNED, ("cost", _L), ("audit", pa.string()))

    def ask(batches):
        trie, last, found = Trie(), None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *(n for n, _ in _SIGNED)))):
                if row[1] != last:
                    last, found = row[1], trie.answer(row[1])
                out.append((*row, *found))
            if out:
                yield _table(out, conv_type, columns)

    dealt = signed.repartitionByRange("signature", F.xxhash64("conv_id")).sortWithinPartitions("signature")
    return dealt.mapInArrow(ask, f"conv_id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


# ---- repaired rows


def _edited(audit: str, rows):
    """(role, text) of a repaired conversation: the audit's edits applied to its rows in order."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = _KEEP[role[0]][state]
            yield role, text
        elif edit == "R":
            state = _NEXT[state]
            yield _ROLE[state], text


def repair(conversations: DataFrame, result: str = "audits") -> DataFrame:
    """The repair of every conversation of a table of rows (conv_id, turn, role, text; and `present`, where rows may stand for
    their conversation alone).

    result="audits": a row for each conversation with gaps, blank, duplicate, truncated, illegal (neighbours of
    roles that can't follow one another), cost, audit and repaired_sha256 (of the lines `role:text`).
    result="rows": the repaired rows: conv_id, place (from 0), role, text.
    """
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), present.alias("present"))
    kind, conv_type = dict(rows.dtypes)["conv_id"], _arrow_type(rows, "conv_id")
    told = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    with scratch(conversations.sparkSession) as keep:
        audits = written(_audited(_signatures(rows)).drop("signature"), "audits")
        # a conversation's audit comes before its rows
        first = audits.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), *told)
        later = rows.where("present").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text", *(F.lit(None).cast("long").alias(c) for c in told))
        both = first.unionByName(later).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.asc_nulls_first("turn"), "role", "digest").drop("digest", "turn")

        def each(batches):
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_row", "role", "text", *told)))

        def rebuild(batches):
            out, held = [], 0
            for conv, some in groupby(each(batches), key=lambda r: r[0]):
                audit = next(some)
                lines = _edited(audit[3], ((r[2], r[3]) for r in some))
                if result == "rows":
                    for place, (role, text) in enumerate(lines):
                        out.append((conv, place, role, text))
                        held += len(text)
                        if held > 1 << 20 or len(out) == 5000:
                            yield _table(out, conv_type, columns)
                            out, held = [], 0
                    continue
                digest = sha256()
                for place, (role, text) in enumerate(lines):
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                out.append((conv, *audit[4:], audit[3], digest.hexdigest()))
                if len(out) == 5000:
                    yield _table(out, conv_type, columns)
                    out = []
            if out:
                yield _table(out, conv_type, columns)

        if result == "rows":
            columns, spec = (("place", _L), ("role", pa.string()), ("text", pa.string())), "place long, role string, text string"
        else:
            columns, spec = (*((c, _L) for c in told), ("audit", pa.string()), ("repaired_sha256", pa.string())), ", ".join(f"{c} long" for c in told) + ", audit string, repaired_sha256 string"
        repaired = both.mapInArrow(rebuild, f"conv_id {kind}, {spec}")
        if result == "rows":
            keep(audits)  # the rows are made when they are asked for
            return repaired
        repaired = written(repaired, "repaired")
        keep(repaired)
    return repaired
