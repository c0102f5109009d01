"""Repair of damaged conversations by the cheapest edits, streamed over sorted rows.

Rows are dealt by conversation and sorted by turn, and the repair runs over the Arrow batches as they come: what it
carries from row to row, and from batch to batch, is a state of fixed size. For each of the four places where a
repaired conversation can stand (nothing yet, after system, user, assistant) that is the cheapest cost, the
rank of the edits so far among the four, and the running hash of the repaired text. Backpointers take four
bytes a row, and those of a giant conversation go to an anonymous scratch file in Spark's own scratch folder, as
Spark's sorts spill; a task that is run again writes them anew.

Edits of two places that have used the same rows differ before their trailing inserts, as the last of the others uses
a row. So their order is settled by ranks and short strings, and edits of equal cost are told apart (by the
least string of initials) without looking back.

What was seen earlier is found by a window in the same partitions, so no set of texts is held in a task. One
conversation is one task, whatever its length: its rows are sorted with spilling and pass one at a time.

Nulls and edge cases: a null role or text counts as one space, in the damage a null id or turn too; null turns come
first; rows of the same turn go by role, then text, before the damage; repeated rows are rows; an empty role has
no initial and no legal place; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Places of a repaired conversation, by the last role; those where it may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Where a role's initial leads from each place, and the role that an insert or a new role must have there.
STEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
LEGAL = {"su", "ua", "au"}
#: Bytes of backpointers of a conversation that stay in memory.
IN_MEMORY = 1 << 20

COLUMNS = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Backpointers:
    """Fixed records a row, in memory up to IN_MEMORY bytes and beyond that in a scratch file."""

    def __init__(self, record: int):
        self.record, self.n, self.held, self.file = record, 0, bytearray(), None

    def add(self, record: bytes) -> None:
        self.held += record
        self.n += 1
        if len(self.held) >= IN_MEMORY:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            self.file.write(self.held)
            self.held.clear()

    def backwards(self) -> Iterator[memoryview]:
        """All records, the last first."""
        size, stop = self.record, 0 if self.file is None else self.file.tell()
        part = bytes(self.held)
        while True:
            for i in range(len(part) - size, -1, -size):
                yield memoryview(part)[i : i + size]
            if not stop:
                break
            start = max(0, stop - IN_MEMORY // size * size)
            self.file.seek(start)
            part, stop = self.file.read(stop - start), start

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Repair:
    """The state of one conversation; rows are fed in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = None
        self.turns = 0
        self.before: str | None = None
        #: Of each place: cost, rank, hash of the repaired text. Before any row only the first can be reached.
        self.places = {NOTHING: (0, 0, hashlib.sha256())}
        self.back = Backpointers(4)

    @staticmethod
    def _line(digest, place: int, role: str, text: str):
        digest = digest.copy()
        digest.update(("" if place == NOTHING else "\n").encode() + f"{role}:{text}".encode())
        return digest

    def _opened(self) -> dict[int, tuple[int, tuple[int, str], int]]:
        """With inserts: of each place the cost, the order of its edits (rank, inserts) and the place they come from."""
        out: dict[int, tuple[int, tuple[int, str], int]] = {}
        for base, (cost, rank, _) in self.places.items():
            place, inserts = base, ""
            for _ in range(3):  # one insert more leads back to a place that has been reached
                new = (cost, (rank, inserts), base)
                if place not in out or new < out[place]:
                    out[place] = new
                place, inserts, cost = NEXT[place][0], inserts + "I", cost + COST["I"]
        return out

    def _hash(self, base: int, inserts: str):
        digest, place = self.places[base][2], base
        for _ in inserts:
            digest, place = self._line(digest, place, NEXT[place][1], ""), NEXT[place][0]
        return digest

    def row(self, turn: str | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        initial, bare = role[:1], text.rstrip(WHITE)
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1

        best: dict[int, tuple] = {}

        def offer(place: int, cost: int, order: tuple[int, str], base: int, came: int, edit: str) -> None:
            new = (cost, (order[0], order[1] + edit), base, came, edit)
            if place not in best or new < best[place]:
                best[place] = new

        for place, (cost, order, base) in self._opened().items():
            offer(place, cost + COST["D"], order, base, place, "D")
            if fault in (None, "truncated"):
                more = TRUNCATED if fault else 0
                if (to := STEP.get(initial, {}).get(place)) is not None:
                    offer(to, cost + COST["K"] + more, order, base, place, "K")
                offer(NEXT[place][0], cost + COST["R"] + more, order, base, place, "R")
        ranks = {order: k for k, order in enumerate(sorted(x[1] for x in best.values()))}
        new, record = {}, bytearray(4)
        for to, (cost, order, base, came, edit) in best.items():
            inserts = order[1][:-1]
            digest = self._hash(base, inserts)
            if edit != "D":
                digest = self._line(digest, came, role if edit == "K" else NEXT[came][1], text)
            new[to] = (cost, ranks[order], digest)
            record[to] = base | len(inserts) << 2 | "DKR".index(edit) << 4
        self.places = new
        self.back.add(bytes(record))

    def result(self, conv_id: str | None) -> tuple:
        opened = self._opened()
        cost, (_, inserts), base = min(opened[p] for p in ENDS if p in opened)
        digest = self._hash(base, inserts)
        audit, place = [inserts], base
        for record in self.back.backwards():
            x = record[place]
            audit.append("I" * (x >> 2 & 3) + "DKR"[x >> 4])
            place = x & 3
        self.back.close()
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        return (conv_id, gaps, *self.counts.values(), cost, "".join(reversed(audit)), digest.hexdigest())


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, turn, role and text after the damage, first_role and first_text (before it), copy (1 for a repetition) and gone (a dropped row)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col))) % 20
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("first_role"), blank(text_col).alias("first_text"), kind.alias("kind"))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("first_role")))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("first_text", ".!?", "")).otherwise(F.col("first_text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("gone", F.col("kind") == 0).withColumn("copy", F.explode(copies)).drop("kind")


def repair(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows (the columns of damage).

    partitions: how many tasks the conversations are dealt to (Spark's setting if not given).
    """
    same = Window.partitionBy("id", F.xxhash64("role", "text"), "role", "text").orderBy(F.asc_nulls_first("turn"), "first_role", "first_text", "copy")
    earlier = F.sum((~F.col("gone")).cast("long")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    # The window's keys begin with the conversation, so it runs in the same partitions, without another shuffle.
    dealt = rows.repartition(*([partitions] if partitions else []), "id").withColumn("seen", F.coalesce(earlier, F.lit(0)) > 0)
    order = ["id", F.asc_nulls_first("turn"), "first_role", "first_text", "copy"]
    stream = dealt.sortWithinPartitions(*order).select(F.col("id").cast("string").alias("id"), F.col("turn").cast("string").alias("turn"), "role", "text", "seen", "gone")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, done = None, None, []
        for batch in batches:
            for conv_id, turn, role, text, seen, gone in batch.itertuples(index=False, name=None):
                if state is None or conv_id != now:
                    if state is not None:
                        done.append(state.result(now))
                    state, now = Repair(), conv_id
                if not gone:
                    state.row(turn, role, text, seen)
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in COLUMNS.split(", ")])
                done = []
        if state is not None:
            yield pd.DataFrame([state.result(now)], columns=[c.split()[0] for c in COLUMNS.split(", ")])
        release_memory()

    return bounded_batches(stream).mapInPandas(run, COLUMNS)


def damaged_repairs(conversations: DataFrame) -> DataFrame:
    """The damage, then the repair of every conversation."""
    out = repair(damage(conversations))
    return out.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))
