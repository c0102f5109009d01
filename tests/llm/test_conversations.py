"""Conversation repair against a search over all edit strings, without the operator's code."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from docloom.llm import conversations

SPACE = "[^\x20\x09-\x0d]"
LEGAL = re.compile("(s?(ua)+)?")
BEGINNING = re.compile("(s?(ua)*u?)?")


def damaged(rows):
    """Rows (conv_id, turn, role, text) after the damage, by conversation, in order."""
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        mine = out.setdefault(c, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows, faults):
    """By uniform cost over whole edit strings: the least (cost, audit) whose roles are legal, and the repaired lines."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        tail = (i, roles[-1:])
        if (tail, audit) in done:
            continue
        done.add((tail, audit))
        if sum(1 for t, a in done if t == tail) > 3:  # the third best way to the same place never wins
            continue
        options = [("I", 3, i, r, (r + ":",)) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            options.append(("D", 4, i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                options.append(("K", more, i + 1, role or "?", (f"{role}:{text}",)))
                options += [("R", 3 + more, i + 1, r, (f"{r}:{text}",)) for r in ("user", "assistant")]
        for edit, price, j, role, line in options:
            if BEGINNING.fullmatch(roles + role[:1]):
                heapq.heappush(queue, (cost + price, audit + edit, j, roles + role[:1], lines + line))


def expected(rows):
    out = {}
    for c, mine in damaged(rows).items():
        seen, faults, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            solid = re.findall(SPACE, text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, text = cheapest(mine, faults)
        out[c] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def rows_of(n, longest, seed):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?", "well", "", " \n", None, "Ärger。", "so. \t", f"x{t}."])
            out.append((c, r.choice([t, t, t, t, t + 3, None]), role, text))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.damaged_repairs(df.withColumnRenamed("nothing", "x")).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0]: tuple(r)[1:] for r in got}


def test_repairs_equal_brute_force(spark):
    rows = rows_of(250, 5, 1) + [(None, None, "user", "Hm."), (None, 1, "assistant", "Ja.")] + [(900, 0, "user", "Hi.")] * 3
    assert found(spark, rows) == expected(rows)


def test_dropped_conversations_stay_in_the_result(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_giant_conversation_spills(monkeypatch, limit):
    monkeypatch.setattr(conversations, "IN_MEMORY", limit)
    state, r = conversations.Repair(), random.Random(5)
    mine = [(t, r.choice(["user", "assistant", "system"]), f"t{t}" + r.choice([".", "", "!"])) for t in range(300)]
    for t, role, text in mine:
        state.row(str(t), role, text, False)
    got = state.result("1")
    # Costs by a plain table over (row, last initial), from the end.
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def with_inserts(cost):
        for _ in range(3):
            cost = {x: min([cost[x]] + [3 + cost[step[x, i]] for i in "ua" if (x, i) in step]) for x in cost}
        return cost

    cost = with_inserts({"": 0, "a": 0, "s": 10**9, "u": 10**9})
    for _, role, text in reversed(mine):
        more = 3 * (text[-1] not in ".!?")
        choices = {x: [4 + cost[x]] + [(0 if i == role[0] else 3) + more + cost[step[x, i]] for i in "sua" if (x, i) in step and (i != "s" or role[0] == "s")] for x in cost}
        cost = with_inserts({x: min(c) for x, c in choices.items()})
    assert got[6] == cost[""] and len(got[7].replace("I", "")) == 300


def test_clashing_names_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "A.", "x", "y"), (1, 1, "assistant", "B.", "x", "y")], "conv_id int, turn int, role string, text string, id string, seen string")
    out = conversations.damaged_repairs(df)
    assert dict(out.dtypes)["conv_id"] == "int" and out.count() == 1


def test_long_texts_and_many_copies(spark):
    rows = [(7, 0, "user", "word " * 800_000 + "end."), (7, 1, "assistant", "Yes. " * 400_000), (7, 2, "user", "Again.")] + [(8, 1, "user", "Same.")] * 400
    assert found(spark, rows) == expected(rows[:3]) | {8: found(spark, rows[3:])[8]}
    got = found(spark, rows[3:])[8]
    n = sum(1 for _ in damaged(rows[3:])[8])
    assert got[2] == n - 1 and got[4] == n - 1 and got[6].count("D") == n - 1  # all but the first are duplicates
