"""Conversation repair against a plain search over all edits, and the query against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from basketlens.llm import conversations
from basketlens.llm.queries import QUERIES

GOOD = re.compile("(s?(ua)+)?")


def all_repairs(letters: str, inserts: int = 2) -> tuple[int, str]:
    """The least (cost, audit) of every choice of edits, with at most so many inserts at a place."""
    options = []
    for letter in letters:
        extra = 5 if letter.isupper() else 0
        one = [(2, "D", "")]
        if letter != "-":
            one += [(extra, "K", letter.lower()), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        options.append(one)
    gaps = [(5 * n, "I" * n, "".join(c)) for n in range(inserts + 1) for c in itertools.product("ua", repeat=n)]
    slots = [gaps]
    for one in options:
        slots += [one, gaps]
    return min(
        (sum(x[0] for x in choice), "".join(x[1] for x in choice))
        for choice in itertools.product(*slots)
        if GOOD.fullmatch("".join(x[2] for x in choice))
    )


def by_table(letters: str) -> tuple[int, str]:
    """The same by a table of the least (cost, audit) of each place and state; a check without bounds."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def put(to, state, value):
        if state is not None and (state not in to or value < to[state]):
            to[state] = value

    def inserted(table):
        for _ in range(2):
            for state, (cost, audit) in list(table.items()):
                for role in "ua":
                    put(table, step.get((state, role)), (cost + 5, audit + "I"))
        return table

    for letter in letters:
        after: dict = {}
        for state, (cost, audit) in inserted(best).items():
            put(after, state, (cost + 2, audit + "D"))
            if letter != "-":
                extra = 5 if letter.isupper() else 0
                put(after, step.get((state, letter.lower())), (cost + extra, audit + "K"))
                for role in "ua":
                    put(after, step.get((state, role)), (cost + extra + 1, audit + "R"))
        best = after
    table = inserted(best)
    return min(table[state] for state in ("", "a") if state in table)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_conversations_against_all_edits(n):
    rng = random.Random(n)
    every = ["".join(x) for x in itertools.product("suaxSUAX-", repeat=n)]
    for letters in rng.sample(every, min(len(every), 40 if n == 3 else 81)):
        assert conversations.cheapest(letters) == all_repairs(letters, 2 if n < 3 else 1), letters


def test_longer_conversations_against_a_table():
    rng = random.Random(12)
    for _ in range(3000):
        letters = "".join(rng.choice(rng.choice(["suaxSUAX-", "ua", "uuaA-", "sx", "UA"])) for _ in range(rng.randint(0, 14)))
        assert conversations.cheapest(letters) == by_table(letters), letters
    for n in (200, 399):
        letters = "".join(rng.choice("suaxSUAX-uaua") for _ in range(n))
        assert conversations.cheapest(letters) == by_table(letters)


def test_bounds_are_below_the_truth():
    rng = random.Random(2)
    for _ in range(300):
        letters = "".join(rng.choice("suaxSUAX-") for _ in range(8))
        assert conversations.bounds(letters)[0][0] <= by_table(letters)[0]


def test_very_long_conversations():
    assert conversations.cheapest("s" + "ua" * 50_000) == (0, "K" * 100_001)
    cost, audit = conversations.cheapest("u" * 20_001)
    assert (cost, len(audit)) == (10_002, 20_001)
    rng = random.Random(4)
    assert conversations.cheapest("".join(rng.choice("suaxSUAX-") for _ in range(30_000)))[0] > 0


def expected(rows) -> Counter:
    """The contract in plain Python; the rows of a turn are all different or all equal."""
    given, after = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        after[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out: Counter = Counter()
    for conv in given:
        inside = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults, letters = set(), Counter(), ""
        for _, role, text in inside:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(inside))
        turns = [r[0] for r in inside if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = by_table(letters)
        todo, fixed, last = iter(inside), [], ""
        for x in audit:
            new = "assistant" if last == "u" else "user"
            if x == "I":
                fixed.append((new, ""))
            else:
                _, role, text = next(todo)
                if x == "D":
                    continue
                fixed.append((new if x == "R" else role, text))
            last = fixed[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in fixed).encode()).hexdigest()
        out[conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest] += 1
    return out


def planted() -> list[tuple]:
    rng = random.Random(1)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "User", "tool"])
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["Yes.", "no", " \t", "", None, "So!\n", "Why? ", "日本。"])))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    # A conversation of a third of all rows, one long text, a conversation without turns, repeated rows.
    rows += [(1000, i, "user" if i % 2 else "assistant", f"Row {i % 50}.") for i in range(500)]
    rows += [(1001, 0, "user", "long " * 200_000 + "?"), (1001, 1, "assistant", "Fine.")]
    rows += [(1002, None, "user", "Same."), (1002, None, "user", "Same.")]
    rows += [(1003, 5, "assistant", "Twice.")] * 3
    return rows


def test_query_against_plain_python(spark, tmp_path):
    rows = planted()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, letter int")
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == expected(rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_the_whole_table(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    found = QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert Counter(map(tuple, found)) == expected(rows)


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_conversation_repair"](spark, str(tmp_path)).count() == 0


def test_repaired_rows(spark):
    rows = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "user", "Hi?"), ("d", 1, "tool", "")], "conv_id string, turn int, role string, text string")
    found = conversations.reports(rows)
    assert {(r.conv_id, r.cost, r.audit) for r in found.collect()} == {("c", 1, "KR"), ("d", 2, "D")}
    fixed = conversations.repaired(rows, found)
    assert sorted(map(tuple, fixed.collect())) == [("c", 0, "user", "Hi."), ("c", 1, "assistant", "Hi?")]
