"""Conversation structure repair (operator 11): secondary-sorted streaming.

Conversations are dealt by id in one shuffle.  Inside a partition one sort and a
window mark repeated turns (role and text seen earlier), a second sort puts each
conversation's last turn first, and ``mapInPandas`` streams through it.  From the
last turn on, a state of four numbers is carried over Arrow batches: the least
cost of making the rest right if the roles kept so far end (0) nowhere, (1) in
``system``, (2) in ``user`` or (3) in ``assistant``.  Each turn leaves one byte,
the best edit in each of the four states; cheapest edits that tie are told apart
by their letter, which gives the ASCII-least audit, since the letters decide from the first
turn on.  At the conversation's first turn the bytes are followed forwards, which
gives the edits and the repaired turns.

A conversation's turns are held up to ``SPILL_BYTES``; beyond that, bytes and turns go to an
unnamed file of the task in blocks, which are read from the last to the first, so
a conversation that holds a third of all rows needs no more memory than any
other.  The order of edits and the hash of a whole conversation go through one
stream by their definition.

A null conversation id is a conversation like any other.  Null turns come
first and count for no gap; rows of one turn are taken by role, then text (UTF-8).
Null roles and texts are one space: such a role fits nowhere and such a text is
blank.  Roles are told apart by their first character alone.  Empty tables give empty
results; a conversation without rows left has zeros, an empty audit and the hash
of nothing.  Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPILL_BYTES = 16 << 20     # text of one conversation held in memory
SPACE = " \t\n\x0b\x0c\r"

LETTERS = "DIKR"           # delete, insert, keep, rerole: in ASCII order
DELETE, INSERT, KEEP, REROLE = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
NAMES = {"u": "user", "a": "assistant"}
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a.  For each, the role that may be written next and its state.
WANTED = "uuau"
AFTER = (2, 2, 3, 2)
KEPT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
DONE = (0, 3)
FINE, BAD, CUT = range(3)  # a turn without fault (for the edits), one to delete, a truncated one


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Plan:
    """Least costs and best edits, step by step from the last turn."""

    def __init__(self, costs: Costs):
        if min(costs.rerole, costs.delete, costs.insert) <= 0 or costs.truncated < 0:
            raise ValueError("edits must cost something")
        self.costs, self.known = costs, {}
        far = 3 * costs.insert  # more than any way to an end by inserting
        self.end = self._inserted([0 if s in DONE else far for s in range(4)])[0]

    def _inserted(self, least: list[int]) -> tuple[tuple[int, ...], set[int]]:
        """Costs when turns may be inserted first, and the states where one is."""
        least, first = list(least), set()
        for _ in range(4):
            for s in range(4):
                if self.costs.insert + least[AFTER[s]] < least[s]:
                    least[s] = self.costs.insert + least[AFTER[s]]
                    first.add(s)
        return tuple(least), first

    def before(self, after: tuple[int, ...], initial: int | None, fault: int) -> tuple[tuple[int, ...], int, int]:
        """Costs ahead of a turn less their minimum, that minimum, and the turn's byte of edits."""
        key = (after, initial, fault)
        if key not in self.known:
            c, cut = self.costs, self.costs.truncated if fault == CUT else 0
            best = []
            for s in range(4):
                ways = [(c.delete + after[s], DELETE)]
                if fault != BAD:
                    if initial is not None and KEPT[s][initial] is not None:
                        ways.append((cut + after[KEPT[s][initial]], KEEP))
                    ways.append((c.rerole + cut + after[AFTER[s]], REROLE))
                best.append(ways)
            low, _ = self._inserted([min(w)[0] for w in best])
            byte = 0
            for s, ways in enumerate(best):
                ways = [*ways, (c.insert + low[AFTER[s]], INSERT)]
                byte |= min(w for w in ways if w[0] == low[s])[1] << 2 * s
            least = min(low)
            self.known[key] = (tuple(x - least for x in low), least, byte)
        return self.known[key]


class _Turns:
    """Turns put in from the last to the first and read from the first to the last."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.held, self.file, self.at = limit, [], 0, None, []

    def put(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.held += size + 64
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.at.append(self.file.tell())
            pickle.dump(self.rows, self.file, protocol=pickle.HIGHEST_PROTOCOL)
            self.rows, self.held = [], 0

    def __iter__(self) -> Iterator[tuple]:
        yield from reversed(self.rows)
        for at in reversed(self.at):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """One conversation, its turns added from the last to the first."""

    def __init__(self, plan: Plan, spill_bytes: int = SPILL_BYTES):
        self.plan, self.turns = plan, _Turns(spill_bytes)
        self.least, self.cost, self.n = plan.end, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.next = ""

    def add(self, turn: int | None, role: str, text: str, end: str, repeated: bool) -> None:
        """``end`` is the last character of the text that isn't white space, or empty."""
        initial, fault = role[:1], FINE
        if not end:
            self.blank, fault = self.blank + 1, BAD
        elif repeated:
            self.duplicate, fault = self.duplicate + 1, BAD
        elif end not in ".!?":
            self.truncated, fault = self.truncated + 1, CUT
        if self.n:
            self.illegal += initial + self.next not in ("su", "ua", "au")
        if turn is not None and turn != self.low:
            self.high = turn if self.high is None else self.high
            self.low, self.distinct = turn, self.distinct + 1
        self.least, extra, byte = self.plan.before(self.least, INITIALS.get(initial), fault)
        self.cost += extra
        self.turns.put((byte, turn, role, None if fault == BAD else text), 0 if fault == BAD else len(text))
        self.next, self.n = initial, self.n + 1

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.distinct

    def edits(self) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """Letter, turn, role and text of each edit, in order; role and text are null where a turn is deleted."""
        s = 0
        for byte, turn, role, text in self.turns:
            while (do := byte >> 2 * s & 3) == INSERT:
                yield "I", None, NAMES[WANTED[s]], ""
                s = AFTER[s]
            if do == DELETE:
                yield "D", turn, None, None
            elif do == KEEP:
                yield "K", turn, role, text
                s = KEPT[s][INITIALS[role[:1]]]
            else:
                yield "R", turn, NAMES[WANTED[s]], text
                s = AFTER[s]
        while s not in DONE:
            yield "I", None, NAMES[WANTED[s]], ""
            s = AFTER[s]
        self.turns.close()

    def summary(self) -> tuple:
        audit, sha, some = bytearray(), hashlib.sha256(), False
        for letter, _, role, text in self.edits():
            audit += letter.encode()
            if letter != "D":
                sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        return (self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + self.least[0], audit.decode(), sha.hexdigest())


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = "place long, edit string, turn long, role string, text string"
_BATCH = 10_000


def _stream(costs: Costs, spill_bytes: int, turns: bool):
    names = [c.split(" ")[0] for c in ("conv string, " + (_REPAIRED if turns else _SUMMARY)).split(", ")]

    def rows(conv, talk):
        if not turns:
            yield (conv, *talk.summary())
            return
        for place, (letter, turn, role, text) in enumerate(talk.edits()):
            yield conv, place, letter, turn, role, text

    def frame(out):
        made = pd.DataFrame(out, columns=names)
        return made.astype({"turn": "Int64"}) if turns else made

    def run(batches):
        plan, at, talk, out = Plan(costs), None, None, []
        for batch in batches:
            cols = [batch[c].tolist() for c in ("conv", "known", "turn", "role", "text", "end", "repeated", "gone")]
            for conv, known, turn, role, text, end, repeated, gone in zip(*cols, strict=True):
                if talk is None or conv != at:
                    if talk is not None:
                        for row in rows(at, talk):
                            out.append(row)
                            if len(out) == _BATCH:
                                yield frame(out)
                                out = []
                    at, talk = conv, Conversation(plan, spill_bytes)
                if not gone:
                    talk.add(turn if known else None, role, text, end, repeated)
        if talk is not None:
            for row in rows(at, talk):
                out.append(row)
                if len(out) == _BATCH:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)
    return run


def repair_conversations(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         costs: Costs = Costs(), gone: Column | None = None, turns: bool = False, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The cheapest repair of each conversation.

    With ``turns``, one row an edit: the id, ``place`` from 0, ``edit`` (its
    letter), and the repaired ``turn``, ``role`` and ``text``.  Else one row a
    conversation: the id, counts of faults, ``cost``, ``audit`` and ``repaired_sha256``.
    Rows where ``gone`` holds only name their conversation."""
    kind = talks.schema[conv_col].dataType.simpleString()
    rows = talks.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
                        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    rows = rows.repartition("conv_id")
    # Clustered by conversation already, so the window only sorts.
    earlier = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("repeated", F.row_number().over(earlier) > 1)
    rows = rows.withColumn("end", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)))
    rows = rows.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("repeated"))
    ins = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").isNotNull().alias("known"),
                      F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "end", "repeated", "gone")
    out = ins.mapInPandas(_stream(costs, spill_bytes, turns), "conv string, " + (_REPAIRED if turns else _SUMMARY))
    return out.select(F.col("conv").cast(kind).alias(conv_col), *[c for c in out.columns if c != "conv"])


def damaged(talks: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage that each row's id and
    turn name: of 20 remainders, 0 drops the row, 1 empties its text, 2 takes out its
    ends of sentences, 3 repeats it and 4 gives it to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = talks.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
                        (F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20).alias("kind"))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation of ``conversations``: faults after the damage, the
    cheapest repair's cost and audit, and the hash of the repaired conversation."""
    talks = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_conversations(talks, gone=F.col("gone"))
