import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from rolefit.llm import conversations as C

SPACE = " \t\n\v\f\r"
ROLES = ("system", "user", "assistant", "tool", "", "sage", "User", None)


def broken(rows):
    """The contract's damage, in plain Python: every conversation with its rows in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows):
    """All the columns of one conversation, by trying every edit from every place on."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def rest(k, said):  # `said`: the initials so far, shortened to what still matters
        ways = [(0, "", ())] if k == len(rows) and re.fullmatch("(s?(ua)+)?", said.replace("i", "")) else []
        if not said.endswith("ii"):
            plain = said.replace("i", "")
            for initial, word in (("u", "user"), ("a", "assistant")):
                if re.fullmatch("s?(ua)*u?", plain + initial):
                    cost, edits, lines = rest_of(k, plain + initial, said.count("i") + 1)
                    ways.append((cost + 2, "I" + edits, (f"{word}:", *lines)))
        if k < len(rows):
            plain = said.replace("i", "")
            cost, edits, lines = rest(k + 1, short(plain))
            ways.append((cost + 3, "D" + edits, lines))
            if faults[k] not in ("blank", "duplicate"):
                extra = faults[k] == "truncated"
                _, role, text = rows[k]
                for edit, initial, word, price in (("K", role[:1], role, 0), ("R", "u", "user", 2), ("R", "a", "assistant", 2)):
                    if initial and re.fullmatch("s?(ua)*u?", plain + initial):
                        cost, edits, lines = rest(k + 1, short(plain + initial))
                        ways.append((cost + price + extra, edit + edits, (f"{word}:{text}", *lines)))
        return min(ways) if ways else (10**9, "", ())

    def short(plain):
        return re.sub("^s?(ua)+(?=ua)", "", plain) if plain.endswith("a") or plain.endswith("u") else plain

    def rest_of(k, plain, inserted):
        return rest(k, short(plain) + "i" * inserted) if inserted < 3 else (10**9, "", ())

    cost, audit, lines = rest(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, conversations, longest=9):
    r, rows = random.Random(seed), []
    for c in range(conversations):
        for turn in range(r.randrange(1, longest)):
            text = r.choice(["Yes.", "No!", "Why", "so?  \n", "", " \t", None, "a. b", "É.", "x" * 300 + "."])
            usual = ["user", "assistant"][turn % 2] if r.random() < 0.6 else r.choice(ROLES)
            rows.append((r.choice([c, c, c, 2**60 + c]), r.choice([turn, turn, turn, None, turn + 5]), usual, text))
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (7, 0, "user", "Yes."), (7, 0, "user", "Yes.")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force(spark, seed):
    rows = made(seed, 150)
    table = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, live boolean, again int").repartition(5)
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in C.repair(C.damaged(table), live="live").collect()}
    assert got == {c: cheapest(own) for c, own in broken(rows).items()}
    assert any("I" in g[6] for g in got.values()) and any("R" in g[6] for g in got.values()) and any(g[0] for g in got.values())


def test_conversations_across_batches_and_spilled(spark, monkeypatch):
    rows = [(k % 3, k // 3, r, t) for k, (_, _, r, t) in enumerate(made(5, 90))]
    plain = {c: cheapest(own)[5:] for c, own in broken(rows).items()}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in C.repair(C.damaged(table), live="live").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain
    monkeypatch.setattr(C, "SPILL_ROWS", 10)
    for c, own in broken(rows).items():
        held, seen = C.Conversation(C.new_folder(spark, "pointers")), set()
        for turn, role, text in own:
            held.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        closed = held.close()
        assert tuple(closed[k] for k in ("cost", "audit", "repaired_sha256")) == plain[c]


def test_nothing_left_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in C.repair(C.damaged(table), live="live").collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damaged(table.limit(0)), live="live").collect() == []
    words = spark.createDataFrame([("a", 1, "user", "Yes."), ("a", 2, "assistant", "No.")], "name string, at int, who string, said string")
    assert [tuple(r)[:7] for r in C.repair(words, "name", "at", "who", "said").collect()] == [("a", 0, 0, 0, 0, 0, 0)]


def test_one_shuffle(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    plan = C.repair(C.damaged(table), live="live")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
