"""Repair of conversations: a generalised LR parse of their roles with weighted edits.

Rows are read in order, once for the cheapest edits and once to apply them.  Of a
conversation a task holds eight bytes a row and its edits, one letter each; texts pass
through.  The rows of one conversation stay in one task, for both the parse and the
digest of the repaired text go from its first row to its last.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import materialize, small_side, text_class

# The role grammar by initials: an optional system row, then pairs of user and assistant; or nothing at all.
GRAMMAR = (("C", ""), ("C", "sP"), ("C", "P"), ("P", "Pua"), ("P", "ua"))
ROLES = {"s": "system", "u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Rows that reach a task as a role's initial (its place here, 0 for any other), and marks to add.
INITIALS = "sua"
MUST_GO, CUT_SHORT = 4, 8
# Edits are stored in pieces of this many letters.
PIECE = 1 << 20
_BLANK, _DUPLICATE, _TRUNCATED = "blank", "duplicate", "truncated"


class Tables:
    """LR states of a grammar: what is shifted, reduced and accepted under each lookahead ("$" ends the rows)."""

    def __init__(self, grammar=GRAMMAR) -> None:
        self.rules = [("S", grammar[0][0]), *grammar]
        left = {a for a, _ in self.rules}
        follow = self._follow(left)
        self.states = [self._closure({(0, 0)}, left)]
        self.goto: dict[tuple[int, str], int] = {}
        for i, items in enumerate(self.states):  # grows on the way
            for x in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                to = self._closure({(r, at + 1) for r, at in items if self.rules[r][1][at:at + 1] == x}, left)
                if to not in self.states:
                    self.states.append(to)
                self.goto[i, x] = self.states.index(to)
        self.reductions = [
            {x: [r for r, at in sorted(items) if r and at == len(self.rules[r][1]) and x in follow[self.rules[r][0]]]
             for x in (*INITIALS, "$")} for items in self.states]
        self.final = {i for i, items in enumerate(self.states) if (0, 1) in items}

    def _closure(self, items: set, left: set) -> frozenset:
        items, new = set(items), list(items)
        while new:
            r, at = new.pop()
            x = self.rules[r][1][at:at + 1]
            found = {(i, 0) for i, (a, _) in enumerate(self.rules) if a == x and x in left} - items
            items |= found
            new.extend(found)
        return frozenset(items)

    def _follow(self, left: set) -> dict[str, set]:
        empty = {a for a, body in self.rules if not body}
        first = {a: set() for a in left}
        follow = {a: {"$"} if a == "S" else set() for a in left}
        starts = lambda x: first[x] if x in left else {x}
        before = None
        while before != (before := repr((empty, first, follow))):
            for a, body in self.rules:
                if all(x in empty for x in body):
                    empty.add(a)
                for x in body:
                    first[a] |= starts(x)
                    if x not in empty:
                        break
                for at, x in enumerate(body):
                    if x in left:
                        for y in body[at + 1:]:
                            follow[x] |= starts(y)
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[a]
        return follow

    def reduced(self, stack: tuple, lookahead: str) -> list[tuple]:
        """``stack`` and the stacks its reductions lead to; a stack is (state, stack below)."""
        found, at = [stack], 0
        while at < len(found):
            for r in self.reductions[found[at][0]][lookahead]:
                below = found[at]
                for _ in self.rules[r][1]:
                    below = below[1]
                to = (self.goto[below[0], self.rules[r][0]], below)
                if to not in found:
                    found.append(to)
            at += 1
        return found

    def shift(self, stack: tuple, x: str) -> list[tuple]:
        return [(self.goto[s[0], x], s) for s in self.reduced(stack, x) if (s[0], x) in self.goto]

    def accepts(self, stack: tuple) -> bool:
        return any(s[0] in self.final for s in self.reduced(stack, "$"))


class Repair:
    """The parse as a machine over rows, its steps worked out once each.

    Between two rows live the tops of the graph-structured stack, each with the stack below
    it (shared between tops), its cost above the cheapest and the place of its edits in ASCII
    order.  Equal tops are merged by minimum (cost, edits).  All edits up to a row end with
    that row's letter, so none is the beginning of another and their order decides before what
    follows does; the order of places is all a step must know of them.  A top dearer than the
    cheapest by more than ``margin`` can not win: two inserts bring the cheapest to the end of
    a pair, where it takes what the other takes, but for a system row, which it deletes.
    """

    margin = 2 * INSERT + DELETE

    def __init__(self, tables: Tables | None = None) -> None:
        self.tables = tables or Tables()
        start = (((0, None), 0),)
        self.frontiers = [start]
        self.number = {start: 0}
        # A step is (next frontier, cost, per top of it the place of its predecessor and the letters since).
        self.steps: list[tuple[int, int, list[tuple[int, str]]]] = []
        self.step_of: dict[int, int] = {}
        self.ends: dict[int, tuple[int, int, str]] = {}

    def _inserted(self, frontier: int) -> dict[int, tuple]:
        """Tops by state after any inserts: ((cost, place, letters), stack)."""
        best: dict[int, tuple] = {}
        new = [((cost, place, ""), stack) for place, (stack, cost) in enumerate(self.frontiers[frontier])]
        while new:
            changed = []
            for key, stack in new:
                if stack[0] not in best or key < best[stack[0]][0]:
                    best[stack[0]] = key, stack
                    changed.append((key, stack))
            new = [((cost + INSERT, place, letters + "I"), to) for (cost, place, letters), stack in changed
                   for x in "ua" for to in self.tables.shift(stack, x)]
        return best

    def step(self, frontier: int, code: int) -> int:
        """The number of the step a row of this code makes from this frontier."""
        known = self.step_of.get(frontier * 16 + code)
        if known is not None:
            return known
        best: dict[int, tuple] = {}

        def offer(key: tuple, stacks: list[tuple]) -> None:
            for stack in stacks:
                if stack[0] not in best or key < best[stack[0]][0]:
                    best[stack[0]] = key, stack

        extra = TRUNCATED if code & CUT_SHORT else 0
        for (cost, place, letters), stack in self._inserted(frontier).values():
            offer((cost + DELETE, place, letters + "D"), [stack])
            if not code & MUST_GO:
                if code & 3:
                    offer((cost + extra, place, letters + "K"), self.tables.shift(stack, INITIALS[(code & 3) - 1]))
                for x in "ua":
                    offer((cost + REROLE + extra, place, letters + "R"), self.tables.shift(stack, x))
        least = min(key[0] for key, _ in best.values())
        kept = sorted((v for v in best.values() if v[0][0] <= least + self.margin), key=lambda v: v[0][1:])
        to = tuple((stack, key[0] - least) for key, stack in kept)
        if to not in self.number:
            self.number[to] = len(self.frontiers)
            self.frontiers.append(to)
        self.steps.append((self.number[to], least, [key[1:] for key, _ in kept]))
        self.step_of[frontier * 16 + code] = len(self.steps) - 1
        return len(self.steps) - 1

    def end(self, frontier: int) -> tuple[int, int, str]:
        """(cost, place, letters) of the cheapest accepted end."""
        if frontier not in self.ends:
            self.ends[frontier] = min(
                key for key, stack in self._inserted(frontier).values() if self.tables.accepts(stack))
        return self.ends[frontier]

    def edits(self, path: Iterable[int], base: int, frontier: int) -> tuple[int, str]:
        """Cost and edits of rows that took the steps ``path`` (a reversible sequence) to ``frontier``, for ``base``."""
        cost, place, letters = self.end(frontier)
        parts = [letters]
        for step in reversed(path):
            place, letters = self.steps[step][2][place]
            parts.append(letters)
        return base + cost, "".join(reversed(parts))


def _code(initial: str, must_go: bool, cut_short: bool) -> int:
    return (INITIALS.find(initial) + 1 if initial else 0) + MUST_GO * must_go + CUT_SHORT * cut_short


def cheapest(rows: Iterable[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits for rows of (role initial, must go, cut short): one conversation, for small uses."""
    repair, frontier, cost, path = Repair(), 0, 0, array("l")
    for row in rows:
        path.append(repair.step(frontier, _code(*row)))
        frontier, more, _ = repair.steps[path[-1]]
        cost += more
    return repair.edits(path, cost, frontier)


# A text without any word; the last character other than space and ASCII controls ends a sentence.
_HAS_WORD = r"[^\x20\x09-\x0D]"
_ENDS = r"[.!?][\x20\x09-\x0D]*\z"


def _clean(rows: DataFrame) -> DataFrame:
    """The four columns the repair looks at; null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))


def _tokens(rows: DataFrame) -> DataFrame:
    """Rows without their texts: initial, own fault, and whether role and text stand at an earlier turn."""
    fault = F.when(~F.col("text").rlike(_HAS_WORD), _BLANK).when(~F.col("text").rlike(_ENDS), _TRUNCATED)
    own = _clean(rows).select("conv_id", "turn", "role", text_class(F.col("text")).alias("digest"), fault.alias("fault"))
    again = materialize(
        own.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "first"),
        "said-again")
    size = F.length("__r") + 48
    seen = own.join(small_side(again, size), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r"))
                    & (F.col("digest") == F.col("__d")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return seen.select("conv_id", "turn", "role", "digest", "fault", later.alias("later"))


_PLAN = "piece int, audit string, cost long, blank long, duplicate long, truncated long, illegal long, gaps long"


def plan_repairs(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation: (conv_id, piece, audit, cost, blank, duplicate, truncated, illegal, gaps).

    ``rows`` has conv_id, turn, role and text; other columns are ignored, an empty table gives
    no rows.  Rows go by turn (nulls first), ties by role and a digest of the text.  Null conv_ids are one
    conversation; null roles and texts count as one space.  Repeated rows are duplicates from
    the second on.  Keep costs 0, Rerole 2, Delete 3 (a must for blank and duplicate rows),
    Insert 2; a truncated row that stays adds 1.  ``audit`` has the edits' initials in order, the
    ASCII-least of equal costs, in pieces; the numbers stand with every piece.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair()
        schema = None
        last, conv, path = None, None, array("l")
        frontier = cost = turns = illegal = 0
        faults: dict[str, int] = {}
        low = high = previous = None
        ids, out = [], []

        def close() -> None:
            total, audit = repair.edits(path, cost, frontier)
            gaps = high - low + 1 - turns if turns else 0
            numbers = (total, faults.get(_BLANK, 0), faults.get(_DUPLICATE, 0), faults.get(_TRUNCATED, 0), illegal, gaps)
            for i in range(0, max(len(audit), 1), PIECE):
                ids.append(conv)
                out.append((i // PIECE, audit[i:i + PIECE], *numbers))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, schema), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()),
                 *(pa.array(c, pa.int64()) for c in columns[2:])],
                names=["conv_id", *(f.split()[0] for f in _PLAN.split(", "))])
            ids.clear()
            out.clear()
            return batch

        for batch in batches:
            schema = batch.schema.field("conv_id").type
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "fault", "later"))):
                here, turn, role, digest, fault, later = row
                if last is None or here != conv:
                    if last is not None:
                        close()
                    conv, path, frontier, cost, turns, illegal, faults = here, array("l"), 0, 0, 0, 0, {}
                    low = high = previous = last = None
                if fault != _BLANK and (later or last == (turn, role, digest)):
                    fault = _DUPLICATE
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                initial = role[:1]
                if previous is not None and previous + initial not in ("su", "ua", "au"):
                    illegal += 1
                if fault is not None:
                    faults[fault] = faults.get(fault, 0) + 1
                step = repair.step(frontier, _code(initial, fault in (_BLANK, _DUPLICATE), fault == _TRUNCATED))
                frontier, more, _ = repair.steps[step]
                cost += more
                path.append(step)
                previous, last = initial, (turn, role, digest)
            if len(out) >= 1000:
                yield flush()
        if last is not None:
            close()
        if out:
            yield flush()

    in_order = _tokens(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return in_order.mapInArrow(run, f"conv_id {kind}, {_PLAN}")


def _in_order(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation the pieces of its edits, then its rows in order."""
    null = lambda kind: F.lit(None).cast(kind)
    texts = _clean(rows).select(
        "conv_id", F.lit(1).alias("kind"), null("int").alias("piece"), "turn", "role", text_class(F.col("text")).alias("digest"), "text")
    edits = plan.select(
        "conv_id", F.lit(0).alias("kind"), "piece", null("bigint").alias("turn"), null("string").alias("role"),
        null("binary").alias("digest"), F.col("audit").alias("text"))
    return edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "piece", "turn", "role", "digest")


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, turn, old role, new role, text) in order, deleted rows included; (conv_id, None, ...) ends a conversation."""
    conv, audit, at, need, open_ = None, "", 0, "u", False

    def rest() -> Iterator[tuple]:
        nonlocal need
        for _ in range(at, len(audit)):
            yield conv, "I", None, None, ROLES[need], ""
            need = "a" if need == "u" else "u"
        yield conv, None, None, None, None, audit

    for batch in batches:
        for here, kind, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "turn", "role", "text"))):
            if kind == 0:
                if open_ and (here != conv or at):
                    yield from rest()
                    open_ = False
                if not open_:
                    conv, audit, at, need, open_ = here, "", 0, "u", True
                audit += text
                continue
            while audit[at] == "I":
                yield conv, "I", None, None, ROLES[need], ""
                need, at = "a" if need == "u" else "u", at + 1
            letter, at = audit[at], at + 1
            new = None if letter == "D" else role if letter == "K" else ROLES[need]
            yield conv, letter, turn, role, new, text
            if new is not None:
                need = "a" if new[:1] == "u" else "u"
    if open_:
        yield from rest()


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of repaired conversations: (conv_id, step, edit, turn, role, text); ``step`` counts from 1, inserted rows have no turn."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, step, last = None, [], 0, None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema.field("conv_id").type
                yield batch

        def flush() -> pa.RecordBatch:
            kinds = (schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "step", "edit", "turn", "role", "text"])

        for conv, edit, turn, _, role, text in _applied(seen()):
            if edit is None:
                step = 0
            elif edit != "D":
                step += 1
                out.append((conv, step, edit, turn, role, text))
                if len(out) >= 1000:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    return _in_order(rows, plan).mapInArrow(run, f"conv_id {kind}, step long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation its edits and the SHA-256 of its repaired rows, `role:text` joined by newlines: (conv_id, audit, repaired_sha256)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, sha, some = None, [], hashlib.sha256(), False

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema.field("conv_id").type
                yield batch

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (schema, pa.string(), pa.string()))],
                names=["conv_id", "audit", "repaired_sha256"])

        for conv, edit, _, _, role, text in _applied(seen()):
            if edit is None:
                out.append((conv, text, sha.hexdigest()))
                sha, some = hashlib.sha256(), False
                if len(out) >= 1000:
                    yield flush()
                    out.clear()
            elif role is not None:
                sha.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
        if out:
            yield flush()

    return _in_order(rows, plan).mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each distinct conv_id of ``ids``: gaps, faults, illegal neighbours, cost, audit and digest.

    A conversation without rows has zeros, no edits and the digest of an empty text.
    """
    plan = materialize(plan_repairs(rows), "repairs")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    numbers = plan.filter("piece = 0").drop("piece", "audit").withColumnRenamed("conv_id", "__n")
    hashed = digests(rows, plan).withColumnRenamed("conv_id", "__h")
    found = numbers.join(hashed, same("__n", "__h"))
    every = ids.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(found, same("conv_id", "__n"), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the checksum of `conv_id:turn` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return (
        conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), mark.alias("__mark"))
        .filter("__mark <> 0")
        .select("conv_id", "turn", F.when(F.col("__mark") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("__mark") == 1, "").when(F.col("__mark") == 2, F.regexp_replace("text", "[.!?]", ""))
                .otherwise(F.col("text")).alias("text"),
                F.explode(F.sequence(F.lit(1), F.when(F.col("__mark") == 3, 2).otherwise(1))).alias("__copy"))
        .drop("__copy"))
