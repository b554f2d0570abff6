"""Conversation structure repair by a survivor-coalescence Viterbi.

The turns of a conversation, in order, are edited until the first letters of their roles read ``(s?(ua)+)?``: a row is kept, given the role user or
assistant (1) or deleted (2), and an empty turn of user or assistant may be put in anywhere (5); keeping or renaming a truncated row costs
5 more. Blank rows and repeats must go. Among the cheapest edits the one whose letters (D, I, K, R) sort first is taken.

Four states say what the repaired turns so far end in: nothing, system, user, assistant. Every state has one survivor, the cheapest way to it, ties
going to the way whose letters sort first. Ways are leaves of a tree of back pointers; nodes count the ways and nodes that hang on them, and one
that nothing hangs on is released. When all survivors share an ancestor, the edits up to it are final: they are emitted and their rows forgotten, so memory holds
only what is still undecided. Tied ways are compared over their whole undecided part, from their last common ancestor on. A survivor goes
early if another one could do whatever it may still do and stay strictly cheaper (``EXCESS``); without this the way that deletes everything would hold the
root for ever.

In Spark: faults that a row shows alone are column expressions, repeats are found by a window over equal rows (spread over tasks however long a conversation is), then
rows are shuffled by conversation and sorted, and each task streams through its conversations. A digest of a repaired conversation is one sequence, so one
conversation passes through one task, as a stream: it is sorted with spilling and never held.

Defined results: a null role or text counts as one space; a null conversation id is a conversation; null turns come first; rows of one turn are ordered by role and
text, and of equal rows the first counts as the original; very long texts are kept whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

WHITE = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a renamed or new turn leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
# EXCESS[x][y]: what x pays at most beyond y for doing what y may still do
EXCESS = {
    NOTHING: {SYSTEM: 0, USER: INSERT_COST, ASSISTANT: 0},
    SYSTEM: {NOTHING: 2 * INSERT_COST, USER: INSERT_COST, ASSISTANT: 2 * INSERT_COST},
    USER: {NOTHING: INSERT_COST + DELETE_COST, SYSTEM: INSERT_COST, ASSISTANT: INSERT_COST},
    ASSISTANT: {NOTHING: DELETE_COST, SYSTEM: 0, USER: INSERT_COST},
}
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 22


class Node:
    """An edit behind another; ``held`` counts the nodes and survivors that hang on it."""

    __slots__ = ("depth", "held", "letter", "parent")

    def __init__(self, parent: Node | None, letter: str):
        self.parent, self.letter, self.held = parent, letter, 0
        self.depth = parent.depth + 1 if parent else 0


def sorts_first(a: Node, b: Node) -> bool:
    """Whether the letters up to ``a`` sort before those up to ``b``."""
    la = lb = ""
    while a is not b:
        deep = a.depth - b.depth
        if deep >= 0:
            a, la = a.parent, a.letter
        if deep <= 0:
            b, lb = b.parent, b.letter
        if deep > 0 and a is b:
            return False  # b's letters begin a's
        if deep < 0 and a is b:
            return True
    return la < lb


class Survivors:
    """The cheapest way to each state; ``settled`` hands out edits that all of them share."""

    def __init__(self):
        self.root = Node(None, "")
        self.ways: dict[int, tuple[int, Node]] = {}
        self._become({NOTHING: (0, self.root)})

    def _offer(self, found: dict, state: int, cost: int, parent: Node, letter: str) -> None:
        if (old := found.get(state)) is None or cost < old[0] or (cost == old[0] and sorts_first(Node(parent, letter), old[1])):
            found[state] = (cost, Node(parent, letter))

    def _become(self, found: dict) -> None:
        for state in sorted(found, key=lambda s: found[s][0]):
            for _ in range(2):  # from nothing or system an assistant takes two new turns
                cost, node = found[state]
                self._offer(found, TURN[state], cost + INSERT_COST, node, "I")
                state = TURN[state]
        old, self.ways = self.ways, {}
        for state, (cost, node) in found.items():
            if not any(x != state and c + EXCESS[x][state] < cost for x, (c, _) in found.items()):
                self.ways[state] = (cost, node)
                self._hold(node)
        for _, node in old.values():
            self._release(node)

    def _hold(self, node: Node) -> None:
        node.held += 1
        while node.held == 1 and node is not self.root:
            node = node.parent
            node.held += 1

    def _release(self, node: Node) -> None:
        node.held -= 1
        while not node.held and node is not self.root:
            node = node.parent
            node.held -= 1

    def row(self, initial: str, fault: int) -> None:
        """The next row."""
        found: dict[int, tuple[int, Node]] = {}
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, (cost, node) in self.ways.items():
            self._offer(found, state, cost + DELETE_COST, node, "D")
            if fault not in (BLANK, DUPLICATE):
                if (to := KEEP.get((state, initial))) is not None:
                    self._offer(found, to, cost + more, node, "K")
                self._offer(found, TURN[state], cost + more + RENAME_COST, node, "R")
        self._become(found)

    def _path(self, node: Node) -> list[Node]:
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]

    def settled(self) -> str:
        """Letters of the edits that all survivors share and that were not handed out yet."""
        out = []
        if self.root.held == 1:
            for node in self._path(next(iter(self.ways.values()))[1]):
                if self.root.held != 1:
                    break
                out.append(node.letter)
                node.parent, self.root = None, node
        return "".join(out)

    def rest(self) -> tuple[int, str]:
        """After the last row: the least cost, and the letters left."""
        ends = [self.ways[s] for s in (NOTHING, ASSISTANT) if s in self.ways]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or (c == cost and sorts_first(n, node)):
                cost, node = c, n
        return cost, "".join(n.letter for n in self._path(node))


class Repair:
    """Edits of one conversation, in order, as ``(edit, turn, role before, role, text, fault)``."""

    def __init__(self):
        self.ways, self.rows, self.state = Survivors(), deque(), NOTHING

    def _edits(self, letters: str) -> Iterator[tuple]:
        for letter in letters:
            if letter == "I":
                self.state = TURN[self.state]
                yield "insert", None, None, ROLE[self.state], "", None
                continue
            turn, before, text, fault = self.rows.popleft()
            role = before
            if letter == "K":
                self.state = KEEP[self.state, before[:1]]
            elif letter == "R":
                self.state = TURN[self.state]
                role = ROLE[self.state]
            yield EDITS[letter], turn, before, role, text, FAULTS[fault]

    def row(self, turn, role: str, text: str, fault: int) -> Iterator[tuple]:
        self.rows.append((turn, role, text, fault))
        self.ways.row(role[:1], fault)
        return self._edits(self.ways.settled())

    def end(self) -> Iterator[tuple]:
        return self._edits(self.ways.rest()[1])


EDITS = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}


def faults(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, fault, nth)`` of every row; ``nth`` counts equal rows of a conversation."""
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(said == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(said, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    return rows.withColumn("nth", nth).withColumn("fault", fault)


class _Rows:
    """Rows on their way to Spark, in batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(self.names)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], self.names)


def edits(df: DataFrame, **columns: str) -> DataFrame:
    """``(conv_id, step, edit, turn, role_before, role, text, fault)``: every edit of every conversation, those of one in order in one partition."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    placed = faults(df, **columns).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    names = ["conv_id", "step", "edit", "turn", "role_before", "role", "text", "fault"]

    def run(batches):
        out, conv, repair, step = None, None, None, 0

        def add(found):
            nonlocal step
            for edit in found:
                out.add((conv, step, *edit), len(edit[4]))
                step += 1
        for b in batches:
            if out is None:
                out = _Rows(names, [b.schema.field(0).type, pa.int64(), pa.string(), b.schema.field(1).type, *[pa.string()] * 4])
            for key, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if repair is None or key != conv:
                    if repair is not None:
                        add(repair.end())
                    conv, repair, step = key, Repair(), 0
                add(repair.row(turn, role, text, fault))
                if out.full():
                    yield out.batch()
        if repair is not None:
            add(repair.end())
            yield out.batch()
    return placed.mapInArrow(run, f"conv_id {kinds['conv_id']}, step long, edit string, turn {kinds['turn']}, role_before string, role string, text string, fault string")


def repaired(df: DataFrame, **columns: str) -> DataFrame:
    """``(conv_id, step, role, text)``: the turns that remain, in the order of ``step``."""
    return edits(df, **columns).filter("edit <> 'delete'").select("conv_id", "step", "role", "text")


LEGAL = {"su", "ua", "au"}


class Summary:
    """Counts and digests of one conversation's edits, taken in order."""

    def __init__(self):
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.count = dict.fromkeys(FAULTS, 0)
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def add(self, edit: str, turn, before: str, role: str, text: str, fault: str) -> None:
        self.audit.append(edit[0].upper())
        if edit != "insert":
            self.count[fault] += 1
            if self.before is not None:
                self.illegal += self.before + before[:1] not in LEGAL
            self.before = before[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.cost += {"keep": 0, "rerole": RENAME_COST, "delete": DELETE_COST, "insert": INSERT_COST}[edit]
        if edit != "delete":
            self.cost += TRUNCATED_COST * (fault == "truncated")
            self.digest.update(("\n" * self.any + role + ":" + text).encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *(self.count[f] for f in FAULTS[1:]), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def summaries(found: DataFrame) -> DataFrame:
    """One row per conversation of ``edits``: gaps between its turns, faults, cost, the edits' letters and a digest of what it becomes."""
    kind = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        out, conv, summary = None, None, None
        for b in batches:
            if out is None:
                out = _Rows(names, [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()])
            for key, *edit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if summary is None or key != conv:
                    if summary is not None:
                        out.add((conv, *summary.row()))
                    conv, summary = key, Summary()
                summary.add(*edit)
                if out.full():
                    yield out.batch()
        if summary is not None:
            out.add((conv, *summary.row()))
            yield out.batch()
    rows = found.select("conv_id", "edit", "turn", "role_before", "role", "text", "fault")
    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Rows of ``df(conv_id, turn, role, text)`` with faults put in by a checksum of conversation and turn: one in twenty each is lost, emptied,
    without its sentence ends, doubled, or said by the user. Nulls of role and text become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("draw"))
    draw, text = F.col("draw"), F.col("text")
    text = F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = rows.filter(draw != 0).select("conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                         F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def damage_repairs(df: DataFrame) -> DataFrame:
    """Summaries of all conversations of ``df`` after damage; one that lost every row has zeros and empty digests."""
    found = summaries(edits(damaged(df))).withColumnRenamed("conv_id", "found_id")
    out = df.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    return out.fillna(0, found.columns[1:7]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
