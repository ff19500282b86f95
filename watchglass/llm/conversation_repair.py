"""Finding and repairing the faults of conversations at the least cost.

A conversation should read `(s?(ua)+)?` by the initials of its roles: perhaps a system
message, then users and assistants in turn. Each row has at most one fault, the first that
holds: blank, a duplicate of an earlier row, truncated. A repair walks through the rows
and keeps (0), reroles to user or assistant (2), deletes (3), or inserts an empty message
of either (2); a truncated row that is not deleted costs 1 more, blank and duplicate rows
must be deleted. Of all cheapest repairs that of the least audit, the initials of its
edits in order, is taken.

The search is a depth-first branch and bound. A node is (rows behind it, where in the
pattern it stands); an explicit stack holds the prefixes to extend, those of lesser
letters on top. A prefix is cut if its cost and the lower bound of its suffix exceed the
incumbent (cost, audit), or if the dominance table knows its node with a cost as low: then
the earlier arrival has the lesser audit too. When the stack is empty the incumbent is
proved. The bounds of suffixes are the least costs of repairing them from each state,
from one sweep backwards, so prefixes are cut as soon as they leave every optimum and no
node is extended twice. The sweep keeps a mark at each BLOCK rows and searches block by
block: a conversation costs time in proportion to its rows, and a byte and a number a row
of memory, as its audit does in the result. Texts never meet there: rows come as codes,
and the repaired texts are hashed as a sorted stream. Which rows are duplicates is found
by an aggregation, so a message repeated any number of times is no group in one task.

Defined results: a null role or text is one space; a null turn sorts first and is left out
of the gaps; a null conv_id is a conversation. Rows of equal turn are in order of role,
then of the digest of role and text. A conversation of which no row is left after the
damage has zeros, an empty audit and the digest of nothing. An empty table gives no row.
Columns other than conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import tasks, written

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".?!"
BLOCK = 1 << 16  # rows searched at once

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
DROPPED = 16  # the code of a row that the damage took away
INITIALS = "sua"  # codes 0, 1, 2; 3 is any other
START, SYSTEM, USER, ASSISTANT = range(4)
INFINITE = 1 << 60
REROLE, DELETE, INSERT = 2, 3, 2
#: The state that a row of role s, u, a or another leads to, by state.
NEXT = {
    START: (SYSTEM, USER, None, None), SYSTEM: (None, USER, None, None),
    USER: (None, None, ASSISTANT, None), ASSISTANT: (None, USER, None, None),
}
#: The state behind a new or reroled message, and its role.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDING = (START, ASSISTANT)  # states in which a conversation may end

SOLVED = (
    "conv string, conv_id long, pos long, row long, before string, role string, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string"
)
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _moves(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each edit that takes the row."""
    fault, initial = divmod(code, 4)
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        more = int(fault == TRUNCATED)
        if NEXT[state][initial] is not None:
            yield "K", more, NEXT[state][initial]
        yield "R", REROLE + more, FOLLOWS[state]


#: The edits of every code and state, worked out once.
MOVES = [[list(_moves(code, state)) for state in range(4)] for code in range(16)]


def _inserted(costs: list[int]) -> list[int]:
    """The costs of states from which messages may be inserted first."""
    for _ in range(3):
        costs = [min(costs[s], INSERT + costs[FOLLOWS[s]]) for s in range(4)]
    return costs


def _bounds(codes: bytes, after: list[int]) -> list[list[int]]:
    """For each row, and behind the last, the least cost of all that follows, by state."""
    out = [after]
    for code in reversed(codes):
        behind = out[-1]
        out.append(_inserted([min(c + behind[t] for _, c, t in MOVES[code][s]) for s in range(4)]))
    return out[::-1]


def branch(codes: bytes, bounds: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The least audit of the cheapest repairs from `state`, and the state it ends in."""
    n = len(codes)
    cost, audit, ends = bounds[0][state], None, state
    seen: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, state, 0, 0, "")]
    while stack:
        i, s, spent, depth, letter = stack.pop()
        bound = spent + bounds[i][s]
        if bound > cost or (bound == cost and audit is not None):
            continue  # no cheaper, and of a greater audit, as lesser letters came first
        if seen.get((i, s), INFINITE) <= spent:
            continue
        seen[i, s] = spent
        del path[depth:]
        path.append(letter)
        if i == n and (not last or s in ENDING):
            cost, audit, ends = bound, "".join(path), s
            continue
        follow = [("I", INSERT, i, FOLLOWS[s])] if last or i < n else []
        if i < n:
            follow += [(name, c, i + 1, t) for name, c, t in MOVES[codes[i]][s]]
        for name, c, j, t in sorted(follow, reverse=True):
            if spent + c + bounds[j][t] <= cost:
                stack.append((j, t, spent + c, len(path), name))
    return audit, ends


def search(codes: bytes) -> tuple[int, str]:
    """The cost and the audit of the best repair of rows given as codes."""
    starts = range(0, max(len(codes), 1), BLOCK)
    end = _inserted([0 if s in ENDING else INFINITE for s in range(4)])
    marks = [end]
    for at in reversed(starts):
        marks.append(_bounds(codes[at : at + BLOCK], marks[-1])[0])
    marks.reverse()
    state, parts = START, []
    for k, at in enumerate(starts):
        block = codes[at : at + BLOCK]
        part, state = branch(block, _bounds(block, marks[k + 1]), state, at + BLOCK >= len(codes))
        parts.append(part)
    return marks[0][START], "".join(parts)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows dropped (marked), emptied, cut, repeated or reroled by their hash."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"),
    ).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("_"),
    ).drop("_")


def _coded(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, digest, row, code of `rows`, without their texts."""
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "row")
    firsts = rows.where("NOT dropped").groupBy("conv", "digest").agg(F.min(place)["row"].alias("first"))
    joined = rows.join(firsts, ["conv", "digest"], "left")
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("row") != F.col("first"), DUPLICATE)
        .when(~F.col("closed"), TRUNCATED).otherwise(NONE)
    )
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    known = (F.length("role") > 0) & (initial > 0)
    code = fault * 4 + F.when(known, initial - 1).otherwise(3)
    return joined.select(
        "conv", "conv_id", "turn", "role", "digest", "row",
        F.when(F.col("dropped"), DROPPED).otherwise(code).cast("int").alias("code"),
    )


class _Conversation:
    """The rows of a conversation under way: a code and a number each, and running facts."""

    def __init__(self, conv: str, conv_id: int | None) -> None:
        self.conv, self.conv_id = conv, conv_id
        self.codes, self.rows = bytearray(), array("q")
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, row: int, code: int) -> None:
        if code == DROPPED:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.codes:
            pair = (self.codes[-1] % 4, code % 4)
            self.illegal += pair not in ((0, 1), (1, 2), (2, 1))
        self.faults[code // 4] += 1
        self.codes.append(code)
        self.rows.append(row)

    def solved(self) -> Iterator[tuple]:
        """A row per message that stays, and a last one of the conversation itself."""
        cost, audit = search(bytes(self.codes))
        at, state, before = 0, START, ""
        for letter in audit:
            if letter == "I":
                state = FOLLOWS[state]
                before += ROLE[state][0]
                continue
            if letter != "D":
                role = None
                if letter == "R":
                    state = FOLLOWS[state]
                    role = ROLE[state]
                else:
                    state = NEXT[state][self.codes[at] % 4]
                yield (self.conv, self.conv_id, at, self.rows[at], before, role, *[None] * 7)
                before = ""
            at += 1
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, blank, duplicate, truncated = self.faults
        yield (self.conv, self.conv_id, at, None, before, None, gaps, blank, duplicate, truncated, self.illegal, cost, audit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted codes of whole conversations: their repairs."""
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 2, *[pa.int64()] * 6, pa.string()]
    names = [c.split()[0] for c in SOLVED.split(", ")]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    held, out = None, []
    for batch in batches:
        for conv, conv_id, turn, row, code in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.conv != conv:
                for r in held.solved() if held else ():
                    out.append(r)
                    if len(out) == 10_000:
                        yield sent(out)
                        out = []
                held = _Conversation(conv, conv_id)
            held.add(turn, row, code)
    for r in held.solved() if held else ():
        out.append(r)
        if len(out) == 10_000:
            yield sent(out)
            out = []
    if out:
        yield sent(out)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted messages of whole conversations, each behind what was inserted: the facts and the digest."""
    digest, first = hashlib.sha256(), True
    names = ["conv_id", *FACTS, "repaired_sha256"]
    for batch in batches:
        done = []
        for conv_id, row, before, role, text, *facts in zip(*(c.to_pylist() for c in batch.columns)):
            lines = [ROLE[USER if x == "u" else ASSISTANT] + ":" for x in before]
            if row is not None:
                lines.append(f"{role}:{text}")
            for line in lines:
                digest.update(line.encode() if first else b"\n" + line.encode())
                first = False
            if row is None:
                done.append((conv_id, *facts, digest.hexdigest()))
                digest, first = hashlib.sha256(), True
        if done:
            kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired messages and the facts of the conversations of `rows`, as `damaged` gives them.

    Messages: conv, conv_id, pos, before, role, text, with the initials of what is inserted
    before each; a last one without text ends each conversation and has its facts.
    """
    n = tasks(rows.sparkSession)
    trimmed = F.rtrim("text", F.lit(SPACE))
    kept = written(
        rows.select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "*",
            F.monotonically_increasing_id().alias("row"), (F.length(trimmed) == 0).alias("blank"),
            F.substring(trimmed, -1, 1).isin(*ENDS).alias("closed"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest"),
        ),
        "conversation-rows",
    )
    ordered = _coded(kept.drop("text")).repartition(n, "conv").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "digest", "row"
    )
    solved = written(ordered.select("conv", "conv_id", "turn", "row", "code").mapInArrow(_solve, SOLVED), "conversation-repairs")
    own = kept.select("row", F.col("role").alias("own"), "text")
    lines = solved.where("row IS NOT NULL").join(own, "row")
    ends = solved.where("row IS NULL").withColumns({"own": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    messages = lines.unionByName(ends).withColumn("role", F.coalesce("role", "own")).drop("own")
    stream = messages.repartition(n, "conv").sortWithinPartitions("conv", "pos", F.col("row").isNull())
    facts = stream.select("conv_id", "row", "before", "role", "text", *FACTS).mapInArrow(
        _hash, "conv_id long, " + ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in FACTS) + ", repaired_sha256 string"
    )
    return messages, facts
