"""Operator 13: conversation structure repair by secondary-sorted streaming: a conversation's rows pass in turn order, and the state of a small dynamic program with them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm._work import mapped, new_folder
from rolefit.llm.token_files import open_store

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after a system row, after a user row, after an assistant row; a conversation ends in the first or the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows whose back-pointers (three bytes a row) a conversation holds in memory; more are spilled to the shared folder.
SPILL_ROWS = 1 << 20

_SPACE = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}
START = ((EMPTY, 0, 0),)


def _moves(state: int, initial: str, must_delete: bool, truncated: bool) -> Iterator[tuple[str, int, int]]:
    """(edits, cost, next state) of all ways over one row from `state`: up to two insertions, then the row kept, reroled or deleted."""
    at, edits, cost = state, "", 0
    for _ in range(3):
        yield edits + "D", cost + DELETE, at
        if not must_delete:
            if initial in _NEXT[at]:
                yield edits + "K", cost + KEEP + TRUNCATED * truncated, _NEXT[at][initial]
            role = "a" if at == USER else "u"
            yield edits + "R", cost + REROLE + TRUNCATED * truncated, _NEXT[at][role]
        at, edits, cost = USER if at != USER else ASSISTANT, edits + "I", cost + INSERT


#: The edits over one row by number; a back-pointer is the state before the row (2 bits) and this number (4 bits).
EDITS = tuple(i + x for i in ("", "I", "II") for x in "DKR")


@cache
def step(front: tuple[tuple[int, int, int], ...], initial: str, must_delete: bool, truncated: bool) -> tuple[tuple[tuple[int, int, int], ...], int, tuple[tuple[int, int, int], ...]]:
    """One row of the dynamic program: (front after it, cost common to all its states, (state, state before, edits) of each).

    A front holds (state, cost above the least, rank of its edits so far among those of all states). Costs of states differ by a few
    edits at most, so there are few fronts, and each pair of a front and a kind of row is worked out once. Edits of two states differ before
    their ends, as all have passed the same rows and end with one; so ranks and the row's own edits order the longer strings too.
    """
    best: dict[int, tuple] = {}
    for state, cost, rank in front:
        for edits, more, after in _moves(state, initial, must_delete, truncated):
            way = (cost + more, rank, edits, state)
            if after not in best or way < best[after]:
                best[after] = way
    least = min(w[0] for w in best.values())
    order = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    states = sorted(best)
    return tuple((s, best[s][0] - least, order[s]) for s in states), least, tuple((s, best[s][3], EDITS.index(best[s][2])) for s in states)


class Pointers:
    """Three bytes a row, six bits a state; all but the last rows lie in a file of the task's own in the shared folder while there are many."""

    def __init__(self, folder: str) -> None:
        self._folder, self._held, self._blocks = folder, bytearray(), []

    def add(self, choices: tuple[tuple[int, int, int], ...]) -> None:
        packed = 0
        for state, before, edits in choices:
            packed |= (before << 4 | edits) << 6 * state
        self._held += packed.to_bytes(3, "little")
        if len(self._held) >= 3 * SPILL_ROWS:
            store, root = open_store(self._folder)
            task = TaskContext.get()
            path = f"{root}/pointers-{task.taskAttemptId() if task else 0}-{len(self._blocks)}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(path) as sink:
                sink.write(bytes(self._held))
            self._blocks.append(path)
            self._held.clear()

    def back(self, state: int) -> str:
        """The edits that lead to `state`, in order; spilled blocks are read once, last first, and deleted."""
        out, blocks = [], [*self._blocks, None]
        for path in reversed(blocks):
            if path is None:
                block = self._held
            else:
                store, _ = open_store(self._folder)
                with store.open_input_file(path) as source:
                    block = source.read()
                store.delete_file(path)
            edits = bytearray()
            for at in range(len(block) - 3, -1, -3):
                own = int.from_bytes(block[at : at + 3], "little") >> 6 * state
                state = own >> 4 & 3
                edits += EDITS[own & 15].encode()[::-1]
            out.append(bytes(edits[::-1]))
        self._blocks = []
        return b"".join(reversed(out)).decode()


def _say(said: tuple, role: str, text: bytes = b"") -> tuple:
    """A digest of a repaired conversation, (hash, whether it has a line), with one line more; the one given stays as it is."""
    digest, begun = said
    digest = digest.copy()
    digest.update(f"{chr(10) if begun else ''}{role}:".encode())
    digest.update(text)
    return digest, True


class Conversation:
    """One conversation as its rows come, in order; `close` gives its row of the result. It holds no text, and of each row three bytes."""

    def __init__(self, folder: str) -> None:
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self._front, self._said, self._initial = START, {EMPTY: (hashlib.sha256(), False)}, None
        self._pointers = Pointers(folder)

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        end = text.rstrip(_SPACE)[-1:]
        blank = not end
        duplicate = again and not blank
        truncated = not blank and not duplicate and end not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        initial = role[:1]
        self.illegal += self._initial is not None and self._initial + initial not in _LEGAL
        self._initial = initial
        self._front, more, choices = step(self._front, initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated)
        self.cost += more
        self._pointers.add(choices)
        said, content = {}, text.encode()
        for state, before, number in choices:
            own, at, edits = self._said[before], before, EDITS[number]
            for _ in edits[:-1]:
                at = ASSISTANT if at == USER else USER
                own = _say(own, _ROLE[at])
            if edits[-1] != "D":
                own = _say(own, role if edits[-1] == "K" else _ROLE[state], content)
            said[state] = own
        self._said = said

    def close(self) -> dict:
        ways = []
        for state, cost, rank in self._front:
            after, edits = {EMPTY: (EMPTY, ""), SYSTEM: (SYSTEM, "II"), USER: (USER, "I"), ASSISTANT: (ASSISTANT, "")}[state]
            ways.append((cost + INSERT * len(edits), rank, edits, after))
        cost, _, edits, state = min(ways)
        own, at = self._said[state], state
        for _ in edits:
            at = ASSISTANT if at == USER else USER
            own = _say(own, _ROLE[at])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        figures = {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost + cost}
        return figures | {"audit": self._pointers.back(state) + edits, "repaired_sha256": own[0].hexdigest()}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live: str | None = None) -> DataFrame:
    """One row for each conversation of `rows`: its faults, and the cheapest edits that make its roles alternate, with a digest of the repaired text.

    Rows are taken by turn (null turns first), equal turns by role and text. One shuffle brings a conversation's rows to one partition; Spark sorts them
    there, on disk if need be, once by role and text, to find repeats, and once by turn; then they pass as a stream, whose batches
    part conversations anywhere. A conversation costs memory by its number of rows alone, three bytes each, and past `SPILL_ROWS` these are spilled to
    the shared folder. Null conversation ids are one conversation; null roles and texts are a single space; rows for which the boolean column `live` is
    not true only make their conversation appear, with zeros, empty edits and the hash of nothing if there are no others. An empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    alive = F.coalesce(F.col(live), F.lit(False)) if live else F.lit(True)
    plain = rows.select(F.col(id_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), alive.alias("live"))
    seen = Window.partitionBy("conv", "live", "role", "text").orderBy(F.asc_nulls_first("turn"))
    ordered = plain.repartition(F.col("conv")).withColumn("again", F.row_number().over(seen) > 1).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    passed = ordered.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "role", "text", "live", "again")
    folder = new_folder(rows.sparkSession, "pointers")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, name = None, None
        for batch in batches:
            done = []
            for conv, turn, has_turn, role, content, is_live, again in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if held is None or conv != name:
                    if held is not None:
                        done.append({"conv": name} | held.close())
                    held, name = Conversation(folder), conv
                if is_live:
                    held.add(turn if has_turn else None, role, content, again)
            if done:
                yield pd.DataFrame(done)
        if held is not None:
            yield pd.DataFrame([{"conv": name} | held.close()])

    found = mapped(passed, stream, f"conv string, {_RESULT}", pandas=True)
    return found.select(F.col("conv").cast(rows.schema[id_col].dataType).alias(id_col), *(x.split()[0] for x in _RESULT.split(", ")))


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text; nulls: one space) with faults by crc32 of `conv_id:turn` modulo 20, and a column `live`.

    0 drops a row (it stays, not live), 1 empties its text, 2 removes sentence marks, 3 repeats it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    own = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    content = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), content.alias("text"), (F.col("fault") != 0).alias("live"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
