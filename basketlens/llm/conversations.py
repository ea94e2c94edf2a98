"""Repair of the structure of conversations by branch and bound.

A conversation is to begin with at most one system row and then alternate user and assistant rows, the last
one an assistant's. Each row may be kept, get another role, or be deleted, and empty rows may be inserted
anywhere; the cheapest edits are wanted, and of equally cheap ones those whose initials are least.

**Search.** Depth first over an explicit stack, the edits of a node in the order of their initials, so leaves come in the order
of their audits. A bound for the rows still to come is the least cost if the conversation may end anywhere (a relaxation,
made from the last row back). A dive along the bounds gives the first incumbent (cost, audit). A node is left
if its cost and bound pass the incumbent's cost, or if its table says that the same place was reached before at
no higher cost: that prefix has the lesser audit, too. An empty stack proves the incumbent. The bound is short of
the truth by the repair of the end at most, so a place is visited a few times, whatever the length.

**Spark.** Faults are found by DataFrame functions. What is gathered for a conversation is one letter a row, in order,
without texts; texts meet the audit in a second pass, which streams sorted rows and holds one audit and no
conversation. A search is for one conversation, and its digest is one stream over its rows, so a single
conversation is not spread over tasks; its letters, about a kilobyte of search tables for ten rows, must fit in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.memo import Memo
from basketlens.llm.tables import tasks

#: Costs of the edits, and of a truncated row that is not deleted (fixed values).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: A row that must be deleted.
GONE = "-"
#: States: nothing yet, after a system row, a user row, an assistant row; a conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The role a new or changed row gets in each state, and the state after a row of an initial.
WANTED = "uuau"
AFTER = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: Letters of short conversations whose repair is remembered by a worker.
REMEMBERED = 200_000
LONGEST = 64
#: Rows in a batch of results.
BATCH = 4096

_NEVER = 1 << 60
_SPACE = " \t\n\x0b\f\r"


def edits(letter: str, state: int) -> list[tuple[str, int, int]]:
    """Initial, cost and next state of the edits of a row, in the order of their initials; without Insert."""
    out = [("D", DELETE, state)]
    if letter != GONE:
        extra = TRUNCATED if letter.isupper() else 0
        kept = AFTER[state].get(letter.lower())
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, AFTER[state][WANTED[state]]))
    return out


_EDITS = {(x, s): edits(x, s) for x in "suaxSUAX-" for s in range(4)}
_INSERTED = [AFTER[s][WANTED[s]] for s in range(4)]


def bounds(letters: str) -> list[list[int]]:
    """For each place and state the least cost of the rest, if a conversation may end in any state."""
    out = [[0, 0, 0, 0]]
    for letter in reversed(letters):
        later = out[-1]
        plain = [min(cost + later[to] for _, cost, to in _EDITS[letter, s]) for s in range(4)]
        out.append([min(plain[s], INSERT + plain[_INSERTED[s]]) for s in range(4)])
    out.reverse()
    return out


def _children(letters: str, at: int, state: int) -> list[tuple[str, int, int, int]]:
    """Initial, cost, next place and state, in the order of the initials."""
    insert = ("I", INSERT, at, _INSERTED[state])
    if at == len(letters):
        return [insert]
    rest = [(x, cost, at + 1, to) for x, cost, to in _EDITS[letters[at], state]]
    return [rest[0], insert, *rest[1:]]


def _dive(letters: str, bound: list[list[int]]) -> tuple[int, str]:
    """A complete repair: at each place the edit of the least cost and bound."""
    at = state = total = 0
    path = []
    while at < len(letters) or state not in ENDS:
        x, cost, at, state = min(_children(letters, at, state), key=lambda c: (c[1] + bound[c[2]][c[3]], -c[2], c[0]))
        total += cost
        path.append(x)
    return total, "".join(path)


def cheapest(letters: str) -> tuple[int, str]:
    """Cost and audit of the best repair of a conversation.

    A letter for each row: ``s``, ``u``, ``a`` by the initial of its role, ``x`` for any other, capitals for truncated
    rows, ``-`` for a row that must go. The audit has an initial for each edit, Keep, Rerole, Delete or Insert.
    """
    bound = bounds(letters)
    best = _dive(letters, bound)
    # A dive's audit may not be the least at its cost; a leaf's is.
    limit = best[0]
    least = [[_NEVER] * 4 for _ in range(len(letters) + 1)]
    stack = [(0, 0, START, 0, "")]
    path: list[str] = []
    while stack:
        depth, at, state, cost, letter = stack.pop()
        if cost + bound[at][state] > limit or least[at][state] <= cost:
            continue
        least[at][state] = cost
        if letter:
            del path[depth - 1 :]
            path.append(letter)
        if at == len(letters) and state in ENDS:
            best = min(best, (cost, "".join(path)))
            limit = cost - 1
            continue
        for x, more, to, then in reversed(_children(letters, at, state)):
            if cost + more + bound[to][then] <= limit:
                stack.append((depth + 1, to, then, cost + more, x))
    return best


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by the CRC of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes full stops, exclamation and question marks out of it, 3 repeats it, 4 makes it
    a user's. A null is one space, also in the hashed text; ids and turns stay null. Extra columns go.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("_fault"))
    return (
        rows.where("_fault <> 0")
        .withColumn("role", F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("role")))
        .withColumn("text", F.expr("CASE _fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END"))
        .withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def _shown(rows: DataFrame) -> DataFrame:
    """The columns in use, nulls of role and text as one space, and a digest of both."""
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def letters(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, letter, again, blank, truncated: equal rows of a turn as one, ``n`` of them.

    ``again`` says that an earlier turn has the same role and text. Equal rows collapse before the shuffle, and where a
    text first stands is a combined minimum, so that neither a hot conversation nor a hot text fills a task.
    """
    text = F.rtrim(F.col("text"), F.lit(_SPACE))
    marked = _shown(rows).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        (text == "").alias("blank"),
        (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    one = marked.groupBy("conv_id", "turn", "role", "digest").agg(
        F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = marked.groupBy(F.col("conv_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return one.join(first, same).select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "n",
        F.when(F.col("truncated"), F.upper(letter)).otherwise(letter).alias("letter"),
        (F.col("_first") != place).alias("again"),
        "blank",
        "truncated",
    )


def _groups(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of each id, in their order, without holding a group; the ids must lie together."""
    rows = (row for batch in batches for row in zip(*(batch[k].to_pylist() for k in kinds), strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def group() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        inside = group()
        yield key, inside
        for _ in inside:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _fields(first: pa.DataType, *rest: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", first), *rest])


def _report(rows: Iterator[tuple], memo: Memo) -> tuple:
    blank = duplicate = truncated = illegal = turns = 0
    before, low, high = "", None, None
    code: list[str] = []
    for _, turn, role, n, letter, again, is_blank, is_truncated in rows:
        if turn is not None:
            low = turn if low is None else low
            turns += turn != high
            high = turn
        initial = role[:1]
        if before != "" or code:
            illegal += before + initial not in ("su", "ua", "au")
        illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
        before = initial
        fresh = 0 if is_blank or again else 1
        blank += n if is_blank else 0
        duplicate += 0 if is_blank else n - fresh
        truncated += 1 if fresh and is_truncated else 0
        code += [letter] * fresh + [GONE] * (n - fresh)
    whole = "".join(code)
    best = memo.get(whole)
    if best is None:
        best = cheapest(whole)
        if len(whole) <= LONGEST:
            memo.put(whole, best)
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps, blank, duplicate, truncated, illegal, *best


_memo = Memo(REMEMBERED)


def reports(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation with rows.

    The rows of a conversation are taken by turn, nulls first, those of one turn by role and a digest of role and text. A
    row's first fault counts: no character but ``[ \\t-\\r]`` (blank); an earlier row of the same role and text
    (duplicate); a last such character other than ``[.!?]`` (truncated). ``gaps`` are the whole numbers between the least and
    the greatest turn that no row has, ``illegal`` counts neighbours whose roles' initials are not su, ua or au.
    ``cost`` and ``audit`` are those of ``cheapest``. Null roles and texts are one space, rows
    with a null id are one conversation, an empty table gives none; other columns are not read.
    """
    frame = letters(rows)
    kind = frame.schema["conv_id"].dataType.simpleString()
    names = ("conv_id", "turn", "role", "n", "letter", "again", "blank", "truncated")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = frame.repartition(tasks(frame.sparkSession), "conv_id").sortWithinPartitions(*order).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _fields(first.schema.field("conv_id").type, *((x, pa.int64()) for x in numbers), ("audit", pa.string()))

        def found() -> Iterator[tuple]:
            for key, group in _groups(_chain(first, batches), names):
                yield key, *_report(group, _memo)

        yield from _batches(found(), schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{x} long' for x in numbers)}, audit string")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def apply(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits of an audit."""
    state = START
    todo = iter(audit)
    for x in todo:
        if x == "I":
            role, text = ROLES[WANTED[state]], ""
        else:
            role, text = next(rows)
            if x == "D":
                continue
            if x == "R":
                role = ROLES[WANTED[state]]
        state = AFTER[state][role[:1]]
        yield role, text


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the conversations after the edits of ``found``, the reports of the rows.

    Positions count from 0. A conversation whose rows are all deleted has no row here. Rows are sorted and streamed; a
    task holds one audit and one batch of rows.
    """
    frame = _shown(rows)
    kind = frame.schema["conv_id"].dataType.simpleString()
    audits = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"))
    both = audits.unionByName(frame.withColumn("kind", F.lit(1)))
    order = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = both.repartition(tasks(frame.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _fields(first.schema.field("conv_id").type, ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()))

        def fixed() -> Iterator[tuple]:
            for key, group in _groups(_chain(first, batches), ("conv_id", "role", "text")):
                audit = next(group)[2]
                for position, (role, text) in enumerate(apply(audit, (row[1:] for row in group))):
                    yield key, position, role, text

        yield from _batches(fixed(), schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, sha256 of the rows ``role:text`` of each repaired conversation, joined by line feeds; streamed."""
    kind = fixed.schema["conv_id"].dataType.simpleString()
    dealt = fixed.repartition(tasks(fixed.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _fields(first.schema.field("conv_id").type, ("sha256", pa.string()))

        def hashed() -> Iterator[tuple]:
            for key, group in _groups(_chain(first, batches), ("conv_id", "role", "text")):
                digest = hashlib.sha256()
                for n, (_, role, text) in enumerate(group):
                    digest.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
                yield key, digest.hexdigest()

        yield from _batches(hashed(), schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, sha256 string")
