"""Audit, splits, rankings, metrics, the pair model, and every registered query against its oracle."""

import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ferrule.functions import hashing
from ferrule.functions.elements import SYMBOLS
from ferrule.operators import audit, metrics, nearest, pairmodel, rankers, selection, splits
from ferrule.plans import experiments
from ferrule.queries import ORACLES, QUERIES

SMALLEST, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def holdout_groups(spark):
    rows = [(f"Li{i}Na1O1", "Li-Na-O", "positive", False) for i in range(1, 11)] + [("K1Na1O1", "K-Na-O", "unlabelled", False), ("K2Na1O1", "K-Na-O", "unlabelled", False), ("K3Na1O1", "K-Na-O", "unresolved", False)]
    return spark.createDataFrame(rows, "composition string, system string, label string, mixed boolean")


def test_holdouts_of_known_seeds(holdout_groups):
    rows = splits.composition_splits(holdout_groups, [0, 1, 19], ("original",)).where("heldout").collect()
    held = {s: {r["composition"] for r in rows if r["seed"] == s} for s in (0, 1, 19)}
    assert held == {s: {f"Li{a}Na1O1" for a in pair} for s, pair in {0: (10, 4), 1: (6, 9), 19: (3, 7)}.items()}
    with pytest.raises(ValueError):
        splits.composition_splits(holdout_groups, [0, 0])
    with pytest.raises(ValueError):
        splits.check_splits(splits.composition_splits(holdout_groups, [0], ("original",)), [5])
    splits.check_splits(splits.composition_splits(holdout_groups, [0], ("original",)), [4])


def test_audit_precedence_and_reasons(spark):
    rows = [("mp-1", "LiNaO", "true", "a:1", "."), ("mp-2", "Li2Na2O2", "unknown", "a:1", "."), ("mp-3", "KNaO", "true", ".", "."), ("mp-4", "LiKO", "false", ".", "."), ("mp-5", "LiKO", "true", "b:2;a:1", ".")]
    rows += [("mp-6", "LiO", "true", ".", "."), ("mp-7", "XxO", "true", ".", "."), ("mp-8", "LiNaO", "true", ".", "invalid_counts"), ("mp-9", None, "true", ".", ".")]
    df = audit.with_reason(spark.createDataFrame(rows, "material_id string, composition string, theoretical string, source_ids string, normalization_issue string"))
    found = {r["composition"]: r for r in audit.groups(df).collect()}
    assert {c: r["label"] for c, r in found.items()} == {"Li1Na1O1": "unresolved", "K1Na1O1": "unlabelled", "K1Li1O1": "positive"}
    assert found["Li1Na1O1"]["material_ids"] == ["mp-1", "mp-2"] and found["Li1Na1O1"]["source_ids"] == ["a:1"]
    assert {r["reason"]: r["n"] for r in audit.exclusion_counts(df).collect()} == {"outside_oxygen_ternary_scope": 1, "unsupported_formula": 2, "normalization_issue": 1}
    one = audit.summary(df, audit.groups(df)).first()
    assert (one["total_records"], one["included_records"], one["unique_compositions"], one["mixed_flag_compositions"], one["has_minimum_pilot_data"]) == (9, 5, 3, 1, False)


def _split(spark, training, candidates, heldout=()):
    rows = [("composition", "original", 0, c, "s", False, "training", False) for c in training] + [("composition", "original", 0, c, "s", False, "candidate", c in heldout) for c in candidates]
    return spark.createDataFrame(rows, "design string, policy string, seed long, composition string, system string, mixed boolean, role string, heldout boolean")


def test_similarity_values(spark):
    split = _split(spark, ["Li1Na1O3", "Li3Na1O1"], ["Li1Na3O1", "Li3Na1O3", "Fe1K1O2"])
    value = {r["composition"]: r["score"] for r in rankers.pu_rank(split, ("similarity",)).collect()}
    slow = {}
    for c, v in {"Li1Na3O1": (1, 3, 1), "Li3Na1O3": (3, 1, 3)}.items():
        slow[c] = max(sum(a * b for a, b in zip(v, t, strict=True)) / (math.sqrt(sum(a * a for a in v)) * math.sqrt(11.0)) for t in ((1, 1, 3), (3, 1, 1)))
    assert value["Li1Na3O1"] == slow["Li1Na3O1"] and value["Li3Na1O3"] == slow["Li3Na1O3"]


def _plain_cosine(a, b):
    shared = sum(n * dict(b).get(s, 0) for s, n in a)
    return min(1.0, shared / (math.sqrt(sum(n * n for _, n in a)) * math.sqrt(sum(n * n for _, n in b))))


def _terms(r, n, least=1):
    symbols = [*SYMBOLS[:20], "O", "O", "O"]
    return [tuple(sorted({r.choice(symbols): r.choice([1, 1, 2, 3, 7, 10**6]) for _ in range(r.randint(least, 5))}.items())) for _ in range(n)]


def _arrow(rows):
    return pa.array([[{"symbol": s, "amount": n} for s, n in t] for t in rows], pa.list_(pa.struct([("symbol", pa.string()), ("amount", pa.int64())])))


@pytest.mark.parametrize(("blocks", "first"), [(1, 16), (7, 1), (40, 3)])
def test_postings_find_the_largest_cosine(monkeypatch, blocks, first):
    r = random.Random(blocks)
    mine, them = _terms(r, 60), _terms(r, 400)
    monkeypatch.setattr(nearest, "FIRST", first)
    monkeypatch.setattr(nearest, "INDEXED", len(them) // blocks)
    monkeypatch.setattr(nearest, "AT_ONCE", 64)
    search = nearest.Search()
    search.add(pa.record_batch([_arrow(mine)], ["terms"]), False)
    for t in range(0, len(them), 10):
        search.add(pa.record_batch([_arrow(them[t : t + 10])], ["terms"]), True)
    rows = [r for b in search.result(["terms"]) for r in b.to_pylist()]
    assert [x["value"] for x in rows] == [max(_plain_cosine(a, b) for b in them) for a in mine]
    assert all(x["pool"] == len(them) for x in rows)


def test_no_more_than_bounds_allow_is_looked_at():
    """Where a candidate has a close neighbour, the lists are left early."""
    r = random.Random(1)
    them = _terms(r, 20_000, 3)
    mine = [tuple((s, n * 50 + 1) for s, n in t) for t in them[:200]]
    search = nearest.Search()
    search.add(pa.record_batch([_arrow(mine)], ["terms"]), False)
    search.add(pa.record_batch([_arrow(them)], ["terms"]), True)
    rows = [x for b in search.result(["terms"]) for x in b.to_pylist()]
    looked = sum(x["looked"] for x in rows) / sum(x["pool"] for x in rows)
    print(f"looked at {looked:.4f} of all pairs")
    assert looked < 0.2 and [x["value"] for x in rows[:20]] == [max(_plain_cosine(a, b) for b in them) for a in mine[:20]]


def test_groups_of_candidates_meet_all_training(spark):
    r = random.Random(2)
    kind = "seed long, composition string, terms array<struct<symbol: string, amount: bigint>>"
    mine = [(seed, f"c{i}", [{"symbol": s, "amount": n} for s, n in t]) for seed in (0, 1, 2) for i, t in enumerate(_terms(r, 30))]
    them = [(seed, f"t{i}", [{"symbol": s, "amount": n} for s, n in t]) for seed in (0, 1, 3) for i, t in enumerate(_terms(r, 50))]
    found = nearest.nearest(spark.createDataFrame(mine, kind), spark.createDataFrame(them, kind), ["seed"], group=4).collect()
    flat = lambda t: [(x["symbol"], x["amount"]) for x in t]
    want = {(s, c): max(_plain_cosine(flat(t), flat(u)) for z, _, u in them if z == s) for s, c, t in mine if s < 2}
    assert {(x["seed"], x["composition"]): x["value"] for x in found} == want and {x["pool"] for x in found} == {50}


def test_popularity_counts_an_element_once_and_unseen_as_zero(spark):
    ranked = rankers.pu_rank(_split(spark, ["Li1Na1O3", "K1Li3O1"], ["Li1Na3O1", "Fe1Ni1O2"]), ("popularity",)).orderBy("rank").collect()
    assert [(r["composition"], r["score"]) for r in ranked] == [("Li1Na3O1", (2 + 1 + 2) / 6), ("Fe1Ni1O2", 2 / 6)]


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("m", i + 1, h) for i, h in enumerate([False, True, True, False])], "method string, rank long, heldout boolean")
    got = {r["budget"]: r for r in metrics.pu_metrics(rows, [1, 2, 3, 4], ["method"]).collect()}
    assert [got[k]["hits"] for k in (1, 2, 3, 4)] == [0, 1, 2, 2]
    for k in (1, 2, 3, 4):
        want = Fraction(k * 2, 4)
        assert (got[k]["random_expected_hits_numerator"], got[k]["random_expected_hits_denominator"]) == (want.numerator, want.denominator)
    with pytest.raises(Exception, match="budget is larger"):
        metrics.pu_metrics(rows, [5], ["method"]).collect()


def test_nearest_rank_and_concentration(spark):
    rows = spark.createDataFrame([("k", f"c{i}", v) for i, v in enumerate([0.0, 0.5, 0.9, 1.0])], "k string, composition string, value double")
    one = metrics.diagnostics(rows, ["k"]).first()
    assert (one["p10"], one["median"], one["p90"], one["max"], one["fraction_ge_09"], one["fraction_ge_099"]) == (0.0, 0.5, 1.0, 1.0, 0.5, 0.25)
    systems = spark.createDataFrame([("k", s) for s in "aaabbcdefg"], "k string, system string")
    assert tuple(metrics.concentration(systems, ["k"]).first())[1:] == (0.3, 0.8)


@pytest.mark.parametrize("bins", [2, 4096])
def test_selection_matches_sorted_values(spark, bins):
    r = random.Random(8)
    groups = {
        "one": [5.0], "ties": [0.5] * 40 + [0.25], "spread": [r.uniform(-1e300, 1e300) for _ in range(60)], "close": [1 + k * 2.0**-52 for k in range(50)], "tiny": [r.choice([0.0, 5e-324, 1e-310, -1e-320, 1.0]) for _ in range(70)],
        "edges": [1.7e308, -1.7e308, 0.0], None: [r.random() for _ in range(200)],
    }
    rows = [(k, i, v) for k, values in groups.items() for i, v in enumerate(values)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, composition long, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {(x["k"], x["share"]): (x["n"], x["v"]) for x in selection.nearest_ranks(table, ["k"], "v", shares, bins).collect()}
    assert found == {(k, p): (len(v), sorted(v)[max(1, math.ceil(p * len(v))) - 1]) for k, v in groups.items() for p in shares}
    assert selection.nearest_ranks(table.limit(0), ["k"], "v", shares).collect() == []
    sums = {x["k"]: x["total"] for x in selection.ordered_sum(table, ["k"], "v", "composition").collect()}
    plain = {}
    for k, _, v in sorted(rows, key=lambda x: x[1]):
        plain[k] = plain.get(k, 0.0) + v
    assert sums == plain


def test_pair_model_gradient_descent():
    r = np.random.RandomState(0)
    n = len(pairmodel.AXIS)
    counts = np.zeros((n, n), int)
    for _ in range(40):
        a, b = r.choice(12, 2, replace=False)
        counts[a, b] += 1
        counts[b, a] = counts[a, b]
    settings = pairmodel.Settings(rank=3, max_iterations=60, missing_weight=0.1)
    f = r.rand(n, 3)
    target, weights = np.log1p(counts) / np.log1p(40), np.where(counts > 0, 1.0, 0.1)
    _, gradient = pairmodel.objective(f, target, weights, 0.01)
    for i, k in ((0, 0), (5, 2), (100, 1)):
        up, down = f.copy(), f.copy()
        up[i, k] += 1e-6
        down[i, k] -= 1e-6
        slope = (pairmodel.objective(up, target, weights, 0.01)[0] - pairmodel.objective(down, target, weights, 0.01)[0]) / 2e-6
        assert math.isclose(slope, gradient[i, k], rel_tol=1e-4, abs_tol=1e-6)
    factors, active, trace, _ = pairmodel.fit(counts, 40, settings)
    assert all(b[1] <= a[1] for a, b in zip(trace, trace[1:], strict=False)) and (factors >= 0).all() and not factors[~active].any()


def test_pair_loss_by_hand():
    """Three elements, two observed pairs; and a point where one pair and the ridge balance."""
    f = np.array([[0.5, 0.2], [0.7, 0.3], [0.1, 0.8]])
    target, weights = np.array([[0, 0.6, 0], [0.6, 0, 0.4], [0, 0.4, 0]]), np.array([[0, 1, 0.01], [1, 0, 1], [0.01, 1, 0]])
    loss, _ = pairmodel.objective(f, target, weights, 0.03)
    assert math.isclose(loss, 0.5 * ((0.41 - 0.6) ** 2 + 0.01 * 0.21**2 + (0.31 - 0.4) ** 2) + 0.015 * (f * f).sum(), abs_tol=1e-14)
    _, slope = pairmodel.objective(np.full((2, 1), 0.7), np.array([[0, 0.5], [0.5, 0]]), np.array([[0.0, 1.0], [1.0, 0.0]]), 0.01)
    assert np.abs(slope).max() < 1e-14
    for bad in ({"rank": 0}, {"rank": True}, {"missing_weight": 0}, {"missing_weight": float("nan")}, {"regularization": 0}, {"regularization": float("inf")}, {"seed": -1}, {"max_iterations": 0}, {"tolerance": float("inf")}):
        with pytest.raises(ValueError):
            pairmodel.Settings(**bad)


def slow_pair_scores(training, candidates, settings):
    """The model by plain loops over all pairs of elements: score of each candidate pair, or None where an element was not met."""
    met = sorted({e for p in training for e in p})
    n = {(a, b): sum(sorted(p) == sorted((a, b)) for p in training) for a in met for b in met if a < b}
    want = {p: math.log1p(c) / math.log1p(len(training)) for p, c in n.items()}
    weight = {p: 1.0 if c else settings.missing_weight for p, c in n.items()}

    def start(element, k):
        digest = __import__("hashlib").sha256(f"{hashing.FACTORS}\n{settings.seed}\n{element}\n{k}".encode()).hexdigest()
        return (0.5 + int(digest[:13], 16) / 2**52) / math.sqrt(10 * settings.rank)

    def value(f):
        slope = {e: [settings.regularization * x for x in f[e]] for e in met}
        loss = 0.5 * settings.regularization * sum(x * x for v in f.values() for x in v)
        for (a, b), w in weight.items():
            miss = sum(x * y for x, y in zip(f[a], f[b], strict=True)) - want[a, b]
            loss += 0.5 * w * miss * miss
            for k in range(settings.rank):
                slope[a][k] += w * miss * f[b][k]
                slope[b][k] += w * miss * f[a][k]
        return loss, slope

    moved = lambda f, slope, step: {e: [max(0.0, x - step * g) for x, g in zip(f[e], slope[e], strict=True)] for e in met}
    distance = lambda f, g: math.sqrt(sum((x - y) ** 2 for e in met for x, y in zip(f[e], g[e], strict=True)))
    f, step, rounds = {e: [start(e, k + 1) for k in range(settings.rank)] for e in met}, 1.0, 0
    loss, slope = value(f)
    goal = settings.tolerance * max(1.0, distance(f, moved(f, slope, 1.0)))
    while rounds < settings.max_iterations and distance(f, moved(f, slope, 1.0)) > goal:
        while True:
            there = moved(f, slope, step)
            lower, after = value(there)
            if lower <= loss + 1e-4 * sum(g * (y - x) for e in met for g, x, y in zip(slope[e], f[e], there[e], strict=True)):
                break
            step /= 2
        f, loss, slope, step, rounds = there, lower, after, min(1.0, 2 * step), rounds + 1
    return {(a, b): sum(x * y for x, y in zip(f[a], f[b], strict=True)) if a in f and b in f else None for a, b in candidates}, rounds


def test_pair_ranking_matches_plain_loops(spark):
    """The registered ranking of one branch of the given tables, with the settings' true values."""
    rows = [r for r in QUERIES["pair_factor_rank"](spark, "/root/testdata/sf0.001").where("seed = 3").collect()]
    split = splits.composition_splits(__import__("ferrule.plans.derived", fromlist=["groups"]).groups(spark, "/root/testdata/sf0.001"), [3], ("original",)).collect()
    pair = lambda c: tuple(e for e in sorted(__import__("re").findall("[A-Z][a-z]?", c)) if e != "O")
    training = [pair(r["composition"]) for r in split if r["role"] == "training"]
    want, _ = slow_pair_scores(training, {pair(r["composition"]) for r in rows}, pairmodel.Settings())
    for r in rows:
        score = want[pair(r["composition"])]
        assert math.isclose(r["score"], score or 0.0, rel_tol=1e-6, abs_tol=1e-9) and r["coverage"] == ("unseen_element_zero" if score is None else "known_elements")
        assert r["observed_training_pair"] == (pair(r["composition"]) in training)
    order = sorted(rows, key=lambda r: (-r["score"], r["tie_key"], r["composition"]))
    assert [r["rank"] for r in order] == list(range(1, len(rows) + 1))
    counted = QUERIES["pair_factor_diagnostics"](spark, "/root/testdata/sf0.001").where("seed = 3").first()
    assert counted["cold_candidates"] == sum(r["coverage"] == "unseen_element_zero" for r in rows) and counted["distinct_scores"] == len({r["score"] for r in rows})


def test_bench_refusals(spark):
    pool = spark.createDataFrame([("Li1O1",), ("K1O1",)], "composition string")
    rankers.check_bench(pool, pool.where("false").unionByName(spark.createDataFrame([("Na1O1",)], "composition string")), [1, 2])
    for candidates, training, budget in ((pool, pool.where("false"), 1), (pool, pool.limit(1), 1), (pool.union(pool), spark.createDataFrame([("Na1O1",)], "composition string"), 1), (pool, spark.createDataFrame([("Na1O1",)], "composition string"), 3)):
        with pytest.raises(ValueError):
            rankers.check_bench(candidates, training, [budget])


def test_hash_uniform(spark):
    row = spark.range(1).select(hashing.key("d", 7, F.lit("x")).alias("k")).select("k", hashing.uniform(F.col("k")).alias("u")).first()
    assert row["u"] == int(row["k"][:13], 16) / 2**52


def test_labels_cannot_change_a_ranking(spark):
    training, candidates = ["Li1Na1O3", "K1Li3O1"], ["Li1Na3O1", "Fe1Ni1O2", "Li5Na1O1"]
    one, two = (sorted(map(tuple, rankers.pu_rank(_split(spark, training, candidates, h)).collect())) for h in ((), candidates[:2]))
    assert one == two


def test_experiment_tables(spark):
    groups = __import__("ferrule.plans.derived", fromlist=["groups"]).groups(spark, "/root/testdata/sf0.01")
    made = experiments.experiment(groups, seeds=[0, 1], policies=("original", "exclude_mixed"), budgets=[20], methods=("popularity", "similarity", "pair_model"))
    assert made["metrics"].count() == 2 * 2 * 2 * 3 and made["population"].count() == 8
    base = made["population"].where("design = 'system'").collect()
    assert all(r["system_overlap_count"] == 0 for r in base)
    seen = experiments.evaluation_only(groups, [0], [20], ("popularity",))
    assert seen["metrics"].count() == 3


def test_entry_and_coverage_of_oracles(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) - len(ORACLES) == 3


def _same(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) else a == b


def _rows(spark, name, sf_dir):
    mine = QUERIES[name](spark, sf_dir)
    return mine.columns, sorted((tuple(r[c] for c in sorted(mine.columns)) for r in mine.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_oracle(spark, name):
    con, sf_dir = duckdb.connect(), SMALLEST
    try:
        columns, got = _rows(spark, name, sf_dir)
    except Exception as error:  # the smallest tables have fewer candidates than some budgets ask for
        assert "budget is larger" in str(error)
        sf_dir = SF
        columns, got = _rows(spark, name, sf_dir)
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(columns) and len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["pu_metrics", "pu_expected_hits_fraction", "method_summary", "saved_ranking_metrics"])
@pytest.mark.parametrize("sizes", ["p_size", "(p_size // 20) * 20 + CASE WHEN p_partkey % 400 < 4 THEN 3 ELSE 10 END"])
def test_budgets_beyond_small_branches(spark, tmp_path, name, sizes):
    """Larger tables merge records into mixed groups, so that exclude_mixed leaves fewer candidates than a budget, or none held out; SQL has these rows too."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (({sizes})::INTEGER AS p_size) FROM '{SMALLEST}/part.parquet') TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    columns, got = _rows(spark, name, str(tmp_path))
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(columns) and len(got) == len(want) > 0
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
