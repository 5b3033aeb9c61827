"""Operator 12: conversation structure repair by generalised LR parsing with weighted edits.

The role grammar is turned into an LR(0) automaton. All stacks that some sequence of edits can reach are kept at once:
stacks share their lower parts, every possible reduction forks the stack it applies to, and stacks that are equal at
the same row are merged by the minimum of (cost, audit). What an edit does to a stack depends only on the stack, the
row's role and its fault, so it is worked out once and then looked up.

Spark deals conversations over tasks and sorts their rows; a task holds one conversation at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .resampling import BYTES, CRC, CRC_TABLE

#: Productions by nonterminal, in capitals; terminals are the initials of roles. S gives (s?(ua)+)?.
GRAMMAR = {"S": ["", "P", "sP"], "P": ["ua", "Pua"]}
START = "S"
#: Roles that a row may be given or that may be inserted, by initial.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Conversations that a task repairs before it hands them on, and the bytes of their rows.
AT_ONCE, BYTES_AT_ONCE = 2000, 8 << 20

TURNS = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Automaton:
    """The LR(0) automaton: a state is the set of productions that may be under way, with the symbols read of each."""

    def __init__(self, grammar: dict[str, list[str]], start: str = START):
        self.grammar, self.start = grammar, start
        self.states = [self._closed({(start, right, 0) for right in grammar[start]})]
        self.goto: dict[tuple[int, str], int] = {}
        for state in self.states:  # new states are appended meanwhile
            for symbol in sorted({right[at] for _, right, at in state if at < len(right)}):
                then = self._closed({(left, right, at + 1) for left, right, at in state if right[at : at + 1] == symbol})
                if then not in self.states:
                    self.states.append(then)
                self.goto[self.states.index(state), symbol] = self.states.index(then)
        self.open = {state for state, symbol in self.goto}
        self.complete = [sorted((left, len(right)) for left, right, at in state if at == len(right)) for state in self.states]

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            _, right, at = todo.pop()
            for more in self.grammar.get(right[at : at + 1], ()):
                item = (right[at], more, 0)
                if item not in items:
                    items.add(item)
                    todo.append(item)
        return frozenset(items)


class Stack:
    """A state on top of a shared lower part; equal stacks are the same object."""

    __slots__ = ("above", "below", "state")

    def __init__(self, state: int, below: Stack | None):
        self.state, self.below, self.above = state, below, {}

    def push(self, state: int) -> Stack:
        if state not in self.above:
            self.above[state] = Stack(state, self)
        return self.above[state]


class Repairer:
    """Weighted edits over the stacks of a grammar. A grammar whose stacks grow without bound keeps a table that grows with its conversations."""

    def __init__(self, grammar: dict[str, list[str]] = GRAMMAR, start: str = START, roles: dict[str, str] = ROLES):
        self.automaton, self.roles = Automaton(grammar, start), roles
        self.bottom = Stack(0, None)
        self._shifts: dict[tuple[Stack, str], list[Stack]] = {}
        self._edits: dict[tuple, list] = {}

    def reductions(self, stack: Stack) -> list[Stack]:
        """What reductions make of a stack, itself included: all stacks that can still read on, and None for a whole parse."""
        out, todo = [], [stack]
        while todo:
            now = todo.pop()
            if now in out:
                continue
            out.append(now)
            for left, length in self.automaton.complete[now.state] if now else ():
                base = now
                for _ in range(length):
                    base = base.below
                then = self.automaton.goto.get((base.state, left))
                if base is self.bottom and left == self.automaton.start:
                    todo.append(None)
                if then is not None:
                    todo.append(base.push(then))
        return [s for s in out if s is None or s.state in self.automaton.open]

    def shift(self, stack: Stack, symbol: str) -> list[Stack]:
        """What is left after a symbol; nothing where it can't follow."""
        key = (stack, symbol)
        if key not in self._shifts:
            then = self.automaton.goto.get((stack.state, symbol)) if symbol else None
            self._shifts[key] = [] if then is None else self.reductions(stack.push(then))
        return self._shifts[key]

    def inserted(self, stack: Stack) -> dict:
        """Stacks that insertions alone reach, each by the fewest: the initials of the inserted roles. None: a whole parse.

        No more are inserted in a row than the automaton has states, which matters only where stacks grow without bound.
        """
        best: dict = {s: "" for s in self.reductions(stack)}
        todo = [s for s in best if s]
        for _ in self.automaton.states:
            later = []
            for now in todo:
                for symbol in sorted(self.roles):
                    for s in self.shift(now, symbol):
                        if s not in best:
                            best[s] = best[now] + symbol
                            later += [s] if s else []
            todo = later
        return best

    def edits(self, stack: Stack, initial: str, must_go: bool, truncated: bool) -> list[tuple[Stack, int, str, str]]:
        """(stack, cost, edits' initials, roles' initials given) for one row, the least of each stack; a kept role is a full stop, a deleted row nothing."""
        key = (stack, initial, must_go, truncated)
        if key not in self._edits:
            best: dict[Stack, tuple] = {}
            for base, given in self.inserted(stack).items():
                if base is None:
                    continue
                before, cost = "I" * len(given), INSERT * len(given)
                ways = [(base, cost + DELETE, before + "D", given)]
                if not must_go:
                    late = cost + TRUNCATED * truncated
                    ways += [(s, late, before + "K", given + ".") for s in self.shift(base, initial)]
                    ways += [(s, late + REROLE, before + "R", given + r) for r in self.roles for s in self.shift(base, r)]
                for s, *way in ways:
                    if s is not None and (s not in best or tuple(way) < best[s]):
                        best[s] = tuple(way)
            self._edits[key] = [(s, *way) for s, way in best.items()]
        return self._edits[key]

    def repair(self, rows: list[tuple[str, bool, bool]]) -> tuple[int, str, str]:
        """(cost, audit, roles given) for rows of (initial, must go, truncated).

        Audits that end with the same row never begin one another, as insertions cost, so an order of those so far and
        the next edits order the longer ones too: only ranks are compared, and edits are read back at the end.
        """
        front = {self.bottom: (0, 0)}
        trail = []
        for initial, must_go, truncated in rows:
            best: dict[Stack, tuple] = {}
            for stack, (cost, rank) in front.items():
                for then, more, edits, given in self.edits(stack, initial, must_go, truncated):
                    way = (cost + more, rank, edits, given, stack)
                    if then not in best or way[:3] < best[then][:3]:
                        best[then] = way
            order = {k: n for n, k in enumerate(sorted({w[1:3] for w in best.values()}))}
            front = {s: (w[0], order[w[1:3]]) for s, w in best.items()}
            trail.append({s: w[2:] for s, w in best.items()})
        last = [(cost + INSERT * len(given), rank, "I" * len(given), given, stack) for stack, (cost, rank) in front.items() if (given := self.inserted(stack).get(None)) is not None]
        if not last:
            raise ValueError("the grammar has no sequence that edits can reach")
        cost, _, edits, given, stack = min(last, key=lambda w: w[:3])
        audits, roles = [edits], [given]
        for step in reversed(trail):
            edits, given, stack = step[stack]
            audits.append(edits)
            roles.append(given)
        return cost, "".join(reversed(audits)), "".join(reversed(roles))


def faults(rows: list[tuple]) -> list[tuple[bool, bool, bool]]:
    """(blank, duplicate, truncated) of rows (turn, role, text), at most one true: the first that applies."""
    seen, out = set(), []
    for _, role, text in rows:
        name = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        body = text.strip(BLANKS)
        blank = not body
        again = not blank and name in seen
        seen.add(name)
        out.append((blank, again, not blank and not again and body[-1] not in ENDS))
    return out


def repaired(rows: list[tuple], repairer: Repairer) -> dict:
    """One conversation's report and turns from its rows (turn, role, text) in order."""
    kinds = faults(rows)
    initials = [role[:1] for _, role, _ in rows]
    cost, audit, given = repairer.repair([(i, b or d, t) for i, (b, d, t) in zip(initials, kinds, strict=True)])
    turns = [t for t, _, _ in rows if t is not None]
    source, roles, out = iter(rows), iter(given), []
    for edit in audit:
        turn, role, text = (None, None, "") if edit == "I" else next(source)
        if edit == "D":
            continue
        new = next(roles)
        out.append({"edit": edit, "turn": turn, "role": role if new == "." else repairer.roles[new], "text": text})
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": sum(b for b, _, _ in kinds), "duplicate": sum(d for _, d, _ in kinds), "truncated": sum(t for _, _, t in kinds),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "turns": out,
    }


def repair_conversations(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns, for every conv_id.

    rows has conv_id, turn, role and text; other columns are ignored. A null text or role is one space: such a text is
    blank, and such a role, like an empty one, can only be changed. Rows of a null conv_id are one conversation. Rows go by turn, nulls
    first, then by role and text, so ties and repeated rows have one order. ``copies`` names a column that says how
    often a row counts, 0 for a conversation's row that is gone; a conversation without rows has zeros and no turns.
    An empty table gives no rows. A conversation is one value of the result, as a text is, and is held by one task;
    all others beside it pass as a stream.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string, turns array<struct<edit: string, turn: long, role: string, text: string>>"

    def run(batches):
        repairer, held, size = Repairer(), [], 0
        id_type = None

        def each() -> Iterable[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def out() -> pa.RecordBatch:
            ids, reports = [i for i, _ in held], [r for _, r in held]
            arrays = [pa.array(ids, id_type), *[pa.array([r[n] for r in reports], pa.int64()) for n in NUMBERS], pa.array([r["audit"] for r in reports], pa.string()), pa.array([r["turns"] for r in reports], pa.list_(TURNS))]
            return pa.record_batch(arrays, ["conv_id", *NUMBERS, "audit", "turns"])

        for conv, members in groupby(each(), key=lambda r: r[0]):
            mine = [(turn, role, text) for _, turn, role, text, n in members for _ in range(n)]
            held.append((conv, repaired(mine, repairer)))
            size += sum(len(text) + 64 for _, _, text in mine)
            if len(held) >= AT_ONCE or size >= BYTES_AT_ONCE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    bounded_batches(rows.sparkSession)
    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after the damage that crc32(conv_id:turn) % 20 names; nulls read as one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(named("text"), ENDS, "")).otherwise(named("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_conversations(damaged(table(spark, sf_dir, "conversations")), "copies")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.select("conv_id", *NUMBERS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


#: A value is nine digits of cost and the audit so far, so the least text is the least (cost, audit); FAR is out of reach.
FAR = "500000000"
_KEY = "concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))"


def _plus(value: str, cost: str | int, edits: str) -> str:
    return f"(printf('%09d', substr({value}, 1, 9)::INTEGER + {cost}) || substr({value}, 10) || '{edits}')"


def _oracle() -> str:
    """Four states (nothing, after s, u, a), each a least value: a plain statement of the cheapest edits, not of the parser."""
    old = [f"v.v{k}" for k in range(4)]
    base = [old[0], old[1], f"least({old[2]}, {', '.join(_plus(old[k], INSERT, 'I') for k in (0, 1, 3))})", f"least({old[3]}, {_plus(old[2], INSERT, 'I')}, {', '.join(_plus(old[k], 2 * INSERT, 'II') for k in (0, 1))})"]
    based = ", ".join(f"'v{k}': {b}" for k, b in enumerate(base))
    late, stays, b = f"(x.late * {TRUNCATED})", "x.go = 0", [f"b.v{k}" for k in range(4)]
    kept = lambda c, k: f"CASE WHEN {stays} AND x.c = '{c}' THEN {_plus(k, late, 'K')} ELSE '{FAR}' END"
    given = lambda k: f"CASE WHEN {stays} THEN {_plus(k, f'{REROLE} + {late}', 'R')} ELSE '{FAR}' END"
    to_u = f"least({b[0]}, {b[1]}, {b[3]})"
    gone = [_plus(x, DELETE, "D") for x in b]
    new = [gone[0], f"least({gone[1]}, {kept('s', b[0])})", f"least({gone[2]}, {kept('u', to_u)}, {given(to_u)})", f"least({gone[3]}, {kept('a', b[2])}, {given(b[2])})"]
    step = f"list_transform([{{{based}}}], lambda b: {{'c': x.c, 'go': x.go, 'late': x.late, {', '.join(f"'v{k}': {n}" for k, n in enumerate(new))}}})[1]"
    seed = f"{{'c': '', 'go': 0, 'late': 0, 'v0': '000000000', 'v1': '{FAR}', 'v2': '{FAR}', 'v3': '{FAR}'}}"
    last = f"least(v.v0, {base[3]})"
    return f"""
WITH crc AS {CRC_TABLE},
k AS (SELECT *, {_KEY} AS key FROM conversations),
n AS (SELECT *, ({CRC.format(bytes=BYTES.format(hex="hex(encode(key))"))}) % 20 AS kind FROM k, crc),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM m),
p AS (SELECT *, tail = '' AS is_blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_dup, substr(role, 1, 1) AS c FROM o),
f AS (SELECT *, NOT is_blank AND NOT is_dup AND tail NOT IN ('.', '!', '?') AS is_cut, c || lead(c) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate, count(*) FILTER (is_cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'c': c, 'go': (is_blank OR is_dup)::INTEGER, 'late': is_cut::INTEGER, 'v0': '', 'v1': '', 'v2': '', 'v3': ''}} ORDER BY pos) AS rows FROM f GROUP BY conv_id),
r AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda v, x: {step}, {seed}) AS v FROM g),
e AS (SELECT * EXCLUDE (v), substr({last}, 1, 9)::BIGINT AS cost, substr({last}, 10) AS audit FROM r),
i AS (SELECT conv_id, j, substr(audit, j, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM e)),
w AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS pos FROM i),
x AS (SELECT w.conv_id, j, edit, role, text, c, row_number() OVER (PARTITION BY w.conv_id ORDER BY j) AS place FROM w LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.pos AND edit <> 'I' WHERE edit <> 'D'),
y AS (SELECT *, place + max(CASE WHEN place = 1 AND edit = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS turn_of FROM x),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN turn_of % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM y GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""


OP12_ORACLE = _oracle()
