"""Conversation structure repair: the cheapest edits after which the roles of a conversation read
``(system? (user assistant)+)?``.

Rows are repartitioned by conversation and sorted by turn inside each partition, so a task
streams its conversations row by row; state is carried across Arrow batches. (``mapInArrow``
instead of ``mapInPandas``: the same stream, and a null turn stays an integer column.)

The program over one conversation has four states, the place in the pattern: nothing yet, after
``system``, after ``user``, after ``assistant``. For each state it carries the least cost and the
order of the edit strings that lead there; of equal costs the smaller string in ASCII is taken.
A step depends only on the costs less the smallest, the order, and the kind of row, so steps
are numbered and kept, and the backpointer of a row is the 2-byte number of its step. A state
dearer than the cheapest by more than ``AHEAD`` cannot be on a cheapest way and is dropped.

Rows whose edit is settled, because the ways to all states have a common beginning, leave at
once. The rest waits in blocks; beyond ``BLOCKS`` of them the older ones go to an unnamed spill
file of the task, which is read back in order and ends with the task, as Spark's own do.
Memory is bounded however long a conversation is; one conversation is one task's work.

Costs: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank rows and duplicates),
Insert an empty user or assistant row 2; a truncated row that stays adds 1.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are
ordered by role and text; rows with a null ``conv_id`` are one conversation; other columns are
not read. A conversation whose rows are all deleted has rows with edit ``D`` only.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.words import EMPTY_SHA, SPACES, bounded_batches, in_slices

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
# From any state, what another state can do costs at most 5 more: an insertion and a deletion.
AHEAD = 6
BLOCK = 1024
BLOCKS = 16

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

Step = tuple[tuple, tuple, tuple, int]


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role does not fit."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    following = NEXT[state]
    return following if ROLE[following][0] == initial else None


def inserted(state: int, count: int) -> int:
    for _ in range(count):
        state = NEXT[state]
    return state


class Steps:
    """Steps of the program, each made once."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.steps: list[Step] = []

    def number(self, costs: tuple, order: tuple, initial: str, fault: int) -> int:
        key = costs, order, initial, fault
        known = self.numbers.get(key)
        if known is None:
            known = self.numbers[key] = len(self.steps)
            self.steps.append(self._made(costs, order, initial, fault))
        return known

    @staticmethod
    def _made(costs: tuple, order: tuple, initial: str, fault: int) -> Step:
        """New costs, new order, ``(state before, edits)`` for each state, and the cost taken off."""
        best: dict[int, tuple] = {}
        extra = CUT if fault == TRUNCATED else 0
        for source, cost in enumerate(costs):
            if cost is None:
                continue
            # A third insertion would come back to a state that had been there.
            for count in range(3):
                state = inserted(source, count)
                ways = [(state, "D", DELETE)]
                if fault not in (BLANK, DUPLICATE):
                    ways.append((kept_state(state, initial), "K", extra))
                    ways.append((NEXT[state], "R", REROLE + extra))
                for target, edit, price in ways:
                    way = cost + INSERT * count + price, order[source], "I" * count + edit, source
                    if target is not None and (target not in best or way < best[target]):
                        best[target] = way
        least = min(way[0] for way in best.values())
        best = {target: way for target, way in best.items() if way[0] - least <= AHEAD}
        ranked = sorted(best, key=lambda target: best[target][1:3])
        return (
            tuple(best[t][0] - least if t in best else None for t in range(4)),
            tuple(ranked.index(t) if t in best else None for t in range(4)),
            tuple((best[t][3], best[t][2]) if t in best else None for t in range(4)),
            least,
        )


START = (0, None, None, None)


class Waiting:
    """Rows and step numbers that wait, in blocks; older blocks in a spill file."""

    def __init__(self):
        self.blocks: list = []
        self.spilled = 0
        self.file = None
        self.size = 0

    def add(self, row: tuple, number: int) -> None:
        if not self.blocks or len(self.blocks[-1][1]) >= BLOCK:
            if len(self.blocks) - self.spilled >= BLOCKS:
                self._spill()
            self.blocks.append(([], array("H")))
        rows, numbers = self.blocks[-1]
        rows.append(row)
        numbers.append(number)
        self.size += 1

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        pickle.dump(self.blocks[self.spilled], self.file, pickle.HIGHEST_PROTOCOL)
        self.blocks[self.spilled] = at
        self.spilled += 1

    def load(self, i: int) -> tuple[list, array]:
        if i >= self.spilled:
            return self.blocks[i]
        self.file.seek(self.blocks[i])
        return pickle.load(self.file)

    def drop(self, blocks: int, rest: tuple[list, array] | None, gone: int) -> None:
        """Without the first ``blocks``, the last of which leaves ``rest``."""
        self.blocks = ([rest] if rest and rest[0] else []) + self.blocks[blocks:]
        self.spilled = max(self.spilled - blocks, 0)
        if self.spilled and rest and rest[0]:
            # A block in memory before spilled ones: put it into the file as well.
            at = self.file.seek(0, 2)
            pickle.dump(rest, self.file, pickle.HIGHEST_PROTOCOL)
            self.blocks[0] = at
            self.spilled += 1
        self.size -= gone
        if not self.spilled and self.file is not None:
            self.file.close()
            self.file = None


class Repair:
    """The program over one conversation; gives ``(row or None, edit, role)`` in order."""

    def __init__(self, steps: Steps):
        self.steps = steps
        self.costs, self.order = START, (0, None, None, None)
        self.base = NOTHING
        self.waiting = Waiting()
        self.check = 2 * BLOCK

    def add(self, row: tuple, initial: str, fault: int) -> Iterator[tuple]:
        number = self.steps.number(self.costs, self.order, initial, fault)
        self.costs, self.order = self.steps.steps[number][:2]
        self.waiting.add(row, number)
        if self.waiting.size >= self.check:
            yield from self._settle()
            self.check = max(2 * BLOCK, 2 * self.waiting.size)

    def end(self) -> Iterator[tuple]:
        ways = []
        for state, cost in enumerate(self.costs):
            if cost is not None:
                count = (0, 2, 1, 0)[state]
                ways.append((cost + INSERT * count, self.order[state], count, state))
        _, _, count, state = min(ways)
        yield from self._leave(len(self.waiting.blocks), None, state)
        for _ in range(count):
            state = NEXT[state]
            yield None, "I", ROLE[state]

    def _settle(self) -> Iterator[tuple]:
        """Rows leave up to the last place where the ways to all states are one."""
        live = {state for state, cost in enumerate(self.costs) if cost is not None}
        for i in range(len(self.waiting.blocks) - 1, -1, -1):
            numbers = self.waiting.load(i)[1]
            for k in range(len(numbers) - 1, -1, -1):
                if len(live) == 1:
                    yield from self._leave(i + 1, k + 1, live.pop())
                    return
                before = self.steps.steps[numbers[k]][2]
                live = {before[state][0] for state in live}

    def _leave(self, blocks: int, upto: int | None, state: int) -> Iterator[tuple]:
        """The rows of the first ``blocks`` (of the last one, ``upto`` rows) on the way to ``state``."""
        last, edits = state, []
        for i in range(blocks - 1, -1, -1):
            numbers = self.waiting.load(i)[1]
            if i == blocks - 1:
                numbers = numbers[:upto]
            here = []
            for number in reversed(numbers):
                state, edit = self.steps.steps[number][2][state]
                here.append(edit)
            # One short code per row: the edits of a block take a byte or so each.
            edits.append(" ".join(reversed(here)))
        at, gone, rest = self.base, 0, None
        for i in range(blocks):
            rows, numbers = self.waiting.load(i)
            text = edits.pop()
            todo = text.split(" ") if text else []
            for row, edit in zip(rows, todo):
                for _ in range(len(edit) - 1):
                    at = NEXT[at]
                    yield None, "I", ROLE[at]
                at, role = self._after(at, row, edit[-1])
                yield row, edit[-1], role
            gone += len(todo)
            if i == blocks - 1:
                rest = rows[len(todo) :], numbers[len(todo) :]
        self.waiting.drop(blocks, rest, gone)
        self.base = last

    @staticmethod
    def _after(state: int, row: tuple, edit: str) -> tuple[int, str | None]:
        if edit == "D":
            return state, None
        if edit == "R":
            return NEXT[state], ROLE[NEXT[state]]
        return kept_state(state, row[1][:1]), row[1]


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault`` by conversation and turn inside each partition."""
    place = [F.col("turn").asc_nulls_first(), "role", "text", "again"]
    filled = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    # Dealt by conversation once: the window over equal rows needs no other shuffle.
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = (
        F.when(body == "", BLANK).when(F.col("again"), DUPLICATE)
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    )
    return (
        filled.repartition("conv_id").withColumn("again", again)
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *place)
        .select("conv_id", "turn", "role", "text", fault.alias("fault"))
    )


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, edit, fault, turn, role, new_role, text`` in the order of the repaired conversations,
    which stand one after the other in each partition.

    Inserted rows (``I``) have no turn and no role, deleted ones (``D``) no new role and no text.
    """
    bounded_batches(turns.sparkSession)
    kinds = "conv_id long, edit string, fault int, turn long, role string, new_role string, text string"
    schema = pa.schema([
        ("conv_id", pa.int64()), ("edit", pa.string()), ("fault", pa.int32()), ("turn", pa.int64()),
        ("role", pa.string()), ("new_role", pa.string()), ("text", pa.string()),
    ])

    def shaped(conv: int | None, settled: Iterator[tuple]) -> Iterator[tuple]:
        for row, edit, role in settled:
            if row is None:
                yield conv, edit, FINE, None, None, role, ""
            else:
                yield conv, edit, row[3], row[0], row[1], role, row[2] if edit != "D" else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        steps, conv, now = Steps(), None, None
        for batch in batches:
            for of, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if now is None or of != conv:
                    if now is not None:
                        yield from shaped(conv, now.end())
                    # Few different steps occur, but their number is bounded by two bytes.
                    if len(steps.steps) > 60_000:
                        steps = Steps()
                    conv, now = of, Repair(steps)
                fault = row[3]
                if fault in (BLANK, DUPLICATE):
                    row[2] = None
                initial = row[1][:1]
                yield from shaped(conv, now.add(tuple(row), initial if initial in "sua" else "", fault))
        if now is not None:
            yield from shaped(conv, now.end())

    return faults(turns).mapInArrow(lambda b: in_slices(rows(b), schema, count=500), kinds)


def report(turns: DataFrame) -> DataFrame:
    """Per conversation ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    schema = pa.schema([
        ("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ])
    kinds = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        names = ("conv_id", "edit", "fault", "turn", "role", "new_role", "text")
        now = None
        for batch in batches:
            for conv, *row in zip(*(batch.column(n).to_pylist() for n in names)):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now.result()
                    now = Digest(conv)
                now.add(*row)
        if now is not None:
            yield now.result()

    return repair(turns).mapInArrow(lambda b: in_slices(rows(b), schema, big=7), kinds)


class Digest:
    """Counts and hash of one conversation as its rows come."""

    def __init__(self, conv: int | None):
        self.conv, self.least, self.last, self.turns = conv, None, None, 0
        self.counts = [0, 0, 0, 0]
        self.illegal = self.cost = 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.sha, self.joined = hashlib.sha256(), False

    def add(self, edit: str, fault: int, turn: int | None, role: str | None, new_role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            self.counts[fault] += 1
            self.cost += CUT if fault == TRUNCATED and edit != "D" else 0
            if turn is not None and turn != self.last:
                self.least = turn if self.least is None else self.least
                self.last, self.turns = turn, self.turns + 1
            initial = role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
        if edit != "D":
            self.sha.update(("\n" if self.joined else "").encode() + f"{new_role}:{text}".encode())
            self.joined = True

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        _, blank, duplicate, truncated = self.counts
        return self.conv, gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in, by the CRC-32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user.
    Nulls are one space there and in roles and texts."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("filled", ".!?", "")).otherwise(F.col("filled"))
    return (
        turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("filled"), kind.alias("kind"))
        .filter("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
        .drop("col")
    )


def report_all(turns: DataFrame, judged: DataFrame) -> DataFrame:
    """``report`` of ``judged`` for each ``conv_id`` of ``turns``, also where no row is left."""
    found = report(judged)
    ids = turns.select(F.col("conv_id").alias("_id")).distinct()
    none = {"audit": "", "repaired_sha256": EMPTY_SHA}
    return ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(none.get(c, 0))).alias(c) for c in found.columns if c != "conv_id"),
    )
