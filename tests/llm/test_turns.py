"""Conversation repair against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ferrule.llm import turns
from ferrule.llm.queries import QUERIES

WORDLIKE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies string, turns string, edit long"


def spaced(x):
    return " " if x is None else str(x)


def damage(rows):
    """Rows by conversation after damage, in order; every conversation is there."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else spaced(role), "" if kind == 1 else spaced(text)
        text = re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, m in out.items()}


def kinds_of(rows):
    out = []
    for n, (_, role, text) in enumerate(rows):
        found = WORDLIKE.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in [(r, t) for _, r, t in rows[:n]] else "truncated" if found[-1] not in ".!?" else "")
    return out


def cheapest(rows, legal=LEGAL, most_inserted=3):
    """(cost, audit, repaired lines) over every choice of edits with a few insertions."""
    kinds, best = kinds_of(rows), None
    inserts = [w for n in range(most_inserted + 1) for w in itertools.product("ua", repeat=n)]
    ways = [["D"] if k in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for k in kinds]
    for choice in itertools.product(*ways):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), most_inserted):
            for word in {w for w in inserts}:
                at = list(places[: len(word)])
                edits = []
                for n in range(len(rows) + 1):
                    edits += ["I" + word[k] for k in range(len(word)) if at[k] == n]
                    edits += [choice[n]] if n < len(rows) else []
                initials, lines, cost, source = "", [], 0, iter(zip(rows, kinds, strict=True))
                for e in edits:
                    if e[0] == "I":
                        initials, cost = initials + e[1], cost + 5
                        lines.append(turns.ROLES[e[1]] + ":")
                        continue
                    (_, role, text), kind = next(source)
                    if e == "D":
                        cost += 2
                        continue
                    cost += (e != "K") + 5 * (kind == "truncated")
                    initials += (role[:1] or "?") if e == "K" else e[1]  # a role without an initial can't be kept
                    lines.append(f"{role if e == 'K' else turns.ROLES[e[1]]}:{text}")
                if legal.fullmatch(initials) and (best is None or (cost, [e[0] for e in edits]) < best[:2]):
                    best = (cost, [e[0] for e in edits], lines)
    return best[0], "".join(best[1]), best[2]


def report(rows):
    kinds, numbers = kinds_of(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(rows, most_inserted=2)
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(4))
def test_repairs_match_every_choice_of_edits(seed):
    r, repairer = random.Random(seed), turns.Repairer()
    for _ in range(12):
        rows = [(n, r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["hi.", "no end", "what?", " ", "hi."])) for n in range(r.randint(0, 3))]
        found = turns.repaired(rows, repairer)
        lines = [f"{t['role']}:{t['text']}" for t in found["turns"]]
        assert (found["cost"], found["audit"], lines) == cheapest(rows), rows


def test_another_grammar_with_growing_stacks():
    """Pairs read from the right: (ua)*, whose stacks grow with the conversation."""
    repairer = turns.Repairer({"S": ["", "uaS"]})
    for word in ("", "ua", "uau", "au", "uuaa", "sua", "uauaua"):
        rows = [(n, {"u": "user", "a": "assistant", "s": "system"}[c], f"text {n}.") for n, c in enumerate(word)]
        cost, audit, _ = repairer.repair([(c, False, False) for c in word])
        if len(word) <= 3:
            assert (cost, audit) == cheapest(rows, re.compile("(ua)*"))[:2]
        else:
            assert (cost == 0) == bool(re.fullmatch("(ua)*", word))


def test_long_conversations_and_ties_settle():
    repairer = turns.Repairer()
    rows = [("u" if n % 2 == 0 else "a", False, n % 7 == 0) for n in range(5000)]
    cost, audit, given = repairer.repair(rows)
    assert len(audit) == 5000 + audit.count("I") and LEGAL.fullmatch("".join(c if g == "." else g for c, g in zip([c for (c, _, _), e in zip(rows, audit, strict=False) if e != "D"], given, strict=False)))
    assert cost == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I") + 5 * sum(late and e != "D" for (_, _, late), e in zip(rows, audit, strict=False))
    # repeated blanks and rows of no role can only go
    assert repairer.repair([("", True, False)] * 50 + [("x", False, True)]) == (102, "D" * 51, "")


def test_damage_and_report_match_plain_loops(spark):
    r = random.Random(5)
    rows = [(c, n, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "Why?", "no end", "\t\n", "Ça va !", "日本"])) for c in range(25) for n in range(r.randint(0, 3))]
    rows += [(None, None, None, None), (None, 1, "user", "a."), (50, None, "user", "x."), (50, None, "user", "x."), (51, 2, "user", "b."), (51, 2, "assistant", "b."), (51, 9, None, ""), (52, 3, "system", None), (53, -4, "user", "q" * 100_000 + ".")]
    table = spark.createDataFrame([(*x, "w", "z", "y", 3) for x in rows], SCHEMA).repartition(7)
    found = turns.repair_conversations(turns.damaged(table), "copies")
    assert found.columns == ["conv_id", *turns.NUMBERS, "audit", "turns"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    got = {x["conv_id"]: tuple(x)[1:] for x in found.select("conv_id", *turns.NUMBERS, "audit", F.sha2(lines, 256)).collect()}
    assert got == {c: report(m) for c, m in damage(rows).items()}
    assert turns.repair_conversations(turns.damaged(table.limit(0)), "copies").collect() == []
    assert got[None] and turns.repair_conversations(table).count() == len(got)  # without damage too, and with columns of the operator's names


def test_query_covers_every_conversation(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = QUERIES["op12_conversation_repair"](spark, sf_dir).collect()
    wanted = {x[0] for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().collect()}
    assert {x["conv_id"] for x in found} == wanted and len(found) == len(wanted)
