"""Benchmark decontamination against plain loops."""

import hashlib
import random
import re

import pytest

from ferrule.llm import decontaminate as op
from ferrule.llm.common import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id string, words string, __row long, start string, classes string, class long"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words_of(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if w else ():
            wanted.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, covered, met = words_of(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wanted:
                    covered |= set(range(i, i + n))
                    met |= wanted[k]
        names = sorted(str(m) for m in met if m is not None)
        out.append((doc, len(w), len(covered), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(covered)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "日本", "x²"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.randint(11, 30))) for i in range(12)]
    items += [(20, items[0][1]), (21, items[0][1].upper().replace(" ", "-- ")), (22, items[1][1] + " " + items[2][1]), (23, "Rare Short"), (24, "rare short words three"), (25, ""), (26, None), (None, items[3][1]), (7, "another text of the same item that has over ten words in it"), (7, items[7][1])]
    docs = [(i, text(r.randint(0, 80))) for i in range(30)]
    docs += [(100 + i, text(9) + "; " + t.title().replace(" ", ", ") + "! " + text(5)) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "--"), (203, "rare"), (204, "rare short"), (205, "Rare, short; rare short words three"), (206, items[0][1]), (206, items[0][1]), (None, items[0][1]), (207, " ".join([items[4][1]] * 300)), (208, " ".join(items[5][1].split()[:9])), (209, " ".join(items[5][1].split()[1:11]))]
    return docs, items


def tables(spark, docs, items):
    left = spark.createDataFrame([(i, t, "x", "y", 4, "z", "u", 5) for i, t in docs], SCHEMA).repartition(6)
    return left, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("window", "block"), [(10, 200_000), (3, 200_000), (10, 40)])
def test_report_matches_plain_loops(spark, window, block):
    docs, items = fixture()
    left, right = tables(spark, docs, items)
    found = op.report(left, right, window, block)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items, window)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With one hash for all windows, the comparison of words alone decides."""
    docs, items = fixture()
    left, right = tables(spark, docs, items)
    monkeypatch.setattr(op, "_window_hash", lambda hashes, at, length, lengths: op.F.get(hashes, at) * 0)
    assert sorted(map(tuple, op.report(left, right).collect()), key=str) == plain(docs, items)


def test_the_plan_has_no_python(spark):
    docs, items = fixture()
    left, right = tables(spark, docs, items)
    work = Workspace(spark, "plan")
    rows = left.select(op.F.monotonically_increasing_id().alias("__row"), "doc_id", op.words(op.F.col("text")).alias("__words"))
    plan = op.all_hits(rows, work.keep(op.classes(right), "classes"), work)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow", plan)


def test_spans_or_documents_are_removed(spark):
    docs, items = fixture()
    left, right = tables(spark, docs, items)
    report = {r[:3] for r in plain(docs, items)}
    cleaned = op.decontaminate(left, right)
    assert cleaned.columns == left.columns
    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    assert len(rows) == len(docs) and {(i, len(words_of(t)) + h) for i, t in rows for d, n, h in report if d == i and n - h == len(words_of(t))} == {(d, n) for d, n, _ in report}
    clean = {d for d, _, h in report if not h}
    assert {r for r in rows if r[0] in clean} == {d for d in docs if d[0] in clean}
    text = dict(rows)
    assert text[206] == "" and text[205] == "" and text[200] is None and text[203] == "rare"
    kept = {r["doc_id"] for r in op.decontaminate(left, right, remove="documents").collect()}
    assert kept == clean
    some = {r["doc_id"] for r in op.decontaminate(left, right, remove="documents", max_share=0.9).collect()}
    assert some == {d for d, n, h in report if h <= 0.9 * n}


def test_empty_tables(spark):
    docs, items = fixture()
    left, right = tables(spark, docs[:4], items)
    assert op.report(left.limit(0), right).collect() == []
    assert sorted(map(tuple, op.report(left, right.limit(0)).collect()), key=str) == plain(docs[:4], [])
    assert op.decontaminate(left, right.limit(0)).count() == 4
    with pytest.raises(ValueError, match="remove"):
        op.decontaminate(left, right, remove="words")
