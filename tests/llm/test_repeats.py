"""Repeated tokens and the skip-chain field: nothing without evidence, one label for identical tokens, planted repeats found."""

import random

import numpy as np
import pytest

from ferrule.llm import pii

TIMES = (2, 3, 5, 7, 13, 20, 40, 100, 200)
CORPUS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(CORPUS).select("doc_id", "text")
    return pii.fit(pii.cases(pii.node_table(docs)))


def added(text, model):
    nodes = pii.Nodes(text, pii.base_spans(text))
    if not nodes.spans:
        return [], 0.0
    return pii.further_spans(np.array(nodes.spans), np.array(nodes.cells), nodes.seen, pii._pairs([x for e in nodes.chain for x in e]), np.array(nodes.merged), pii._pairs([x for e in nodes.links for x in e]), model)


@pytest.mark.parametrize("token", ["2024-01-15", "covid2019pandemic", "14155550134", "AB-1234567", "978-3-16-148410-0", "v12.34.5678", "20240115T101500"])
def test_repeats_without_evidence_add_nothing(model, token):
    for n in TIMES:
        for glue in (" and then ", " ", "\n"):
            text = glue.join([token] * n)
            if not pii.base_spans(text):
                assert added(text, model)[0] == [], (token, n)


def test_all_repeats_of_an_observed_number_are_labelled_alike(model):
    for n in TIMES:
        for glue in (" was called, ", " "):
            text = "Ring +14155550134 now: " + glue.join(["14155550134"] * n)
            spans, left = added(text, model)
            at = [i for i in range(len(text)) if text.startswith("14155550134", i) and text[i - 1] != "+"]
            ours = [s for s in spans if s[1] == pii.KINDS.index("phone")]
            covered = {i for a, _, b in ours for i in at if a <= i < b}
            assert covered == set(at) and len(spans) == len(ours) and left < pii.SETTLED, (n, glue)


def test_other_tokens_beside_evidence_stay_outside(model):
    for n in TIMES:
        text = "Ring +14155550134 on 2024-01-15. " + "Meet on 2024-01-15 in room 77. " * n + "mail a@example.com "
        assert added(text, model)[0] == [], n


def test_parts_of_a_repeated_number(model):
    text = "Ring +1 (415) 555-0134 today. Then (415) 555-0134 again, and 555-0134 77 times, in 415 rooms."
    assert [text[a:b] for a, _, b in added(text, model)[0]] == ["415) 555-0134", "555-0134"]


def test_a_corpus_of_dates_has_no_personal_data(spark):
    docs = [(i, "On " + "2024-01-15 we met. " * n) for i, n in enumerate([2, 5, 20, 200] * 7)]
    rows = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(CORPUS).select("doc_id", "text")).collect()
    assert all(r["n_added"] == r["n_secret"] == 0 and r["spans"] == "" and r["unsettled"] == 0 for r in rows)
    alone = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["n_added"] == r["n_secret"] == 0 for r in alone)


def test_precision_and_recall_over_planted_documents(spark):
    r = random.Random(9)
    docs, want = [], {}
    for i in range(300):
        number = f"{r.choice('23456789')}{r.randint(10**9, 10**10 - 1)}"
        words = [r.choice(["report", "meeting", "of", "the", f"item {r.randint(1, 99)},", f"2023-0{r.randint(1, 9)}-1{r.randint(0, 9)},", f"ref{r.randint(10**6, 10**7)},"]) for _ in range(60)]
        observed = i % 2 == 0
        repeats = r.sample(range(3, 58), r.choice([1, 2, 8, 20]))
        for k in repeats:
            words[k] = f"({number})," if k % 2 else f"{number},"  # no run of digits that a card could be
        text = " ".join([f"call +{number} :" if observed else "nothing here :", *words])
        docs.append((i, text))
        want[i] = {a for a in range(len(text)) if observed and text.startswith(number, a) and text[a - 1] != "+"}
    right = wrong = missed = 0
    for row in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(CORPUS).select("doc_id", "text")).collect():
        base = set(pii._joined(pii.base_spans(docs[row["doc_id"]][1])).split(","))
        found = {int(s.split(":")[1]) for s in row["spans"].split(",") if s and s not in base}
        right, wrong, missed = right + len(found & want[row["doc_id"]]), wrong + len(found - want[row["doc_id"]]), missed + len(want[row["doc_id"]] - found)
    print(f"precision {right / max(1, right + wrong):.3f}, recall {right / max(1, right + missed):.3f} of {right + missed}")
    assert right / (right + wrong) >= 0.98 and right / (right + missed) >= 0.95
