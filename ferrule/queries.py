"""The registered queries of the composition engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formula as fm
from .functions import hashing
from .operators import analysis, audit, metrics, pairmodel, query, rankers, splits, validate
from .plans import experiments
from .plans import oracles as sql
from .plans.derived import AUDITED, CLEAN, LEGACY, SCORED, canonical, clean, groups, legacy, records, scored
from .plans.workspace import Workspace
from .sources import scores, sinks, sqlite_sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUDGETS, SEEDS, BENCH_SEEDS = splits.BUDGETS, splits.SEEDS, (0, 1, 2)
REFERENCE = "Al2Ti1O5"


def registered(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _bad(spark, sf):
    return query.validated(scored(spark, sf))


def _formulas(spark, sf, *columns):
    return clean(spark, sf).select(F.col("composition").alias("raw"), *columns).distinct()


def _filtered(spark, sf, **filters):
    return query.matching(scored(spark, sf), query.QueryFilters.of(**filters)).select(F.col("formula").alias("composition"), "score")


# Formulas


@registered(f"WITH {CLEAN} SELECT DISTINCT raw, formula FROM clean")
def formula_canonical(spark, sf):
    return _formulas(spark, sf, "formula")


@registered(f"WITH {CLEAN} SELECT DISTINCT raw, array_to_string(species, ' ') AS species FROM clean")
def formula_species(spark, sf):
    return _formulas(spark, sf, F.array_join("species", " ").alias("species"))


@registered(f"WITH {CLEAN} SELECT DISTINCT raw, nary FROM clean")
def formula_arity(spark, sf):
    return _formulas(spark, sf, "nary")


@registered(f"WITH {CLEAN} SELECT DISTINCT raw, system FROM clean")
def formula_system(spark, sf):
    return _formulas(spark, sf, "system")


@registered(f"WITH {CLEAN} SELECT DISTINCT raw || raw AS doubled, formula FROM clean")
def formula_repeat_merge(spark, sf):
    doubled = clean(spark, sf).select(F.concat("composition", "composition").alias("doubled")).distinct()
    return fm.with_composition(doubled, "doubled").select("doubled", "formula")


@registered(f"WITH {CLEAN} SELECT DISTINCT formula, norm FROM clean")
def formula_norm(spark, sf):
    return clean(spark, sf).select("formula", fm.norm(F.col("terms")).alias("norm")).distinct()


# Scan, filter, rank


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE score >= 0.9")
def query_threshold_inclusive(spark, sf):
    return _filtered(spark, sf, threshold=0.9)


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE score > 0.9")
def query_threshold_strict(spark, sf):
    return _filtered(spark, sf, threshold=0.9, inclusive=False)


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE score >= 0.01 AND list_contains(species, 'Al') AND list_contains(species, 'Si')")
def query_elements_all(spark, sf):
    return _filtered(spark, sf, elements=["Al", "Si"])


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE score >= 0.01 AND nary IN (3, 5)")
def query_arity(spark, sf):
    return _filtered(spark, sf, nary=[3, 5])


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE false")
def query_arity_empty(spark, sf):
    return _filtered(spark, sf, nary=[])


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE score >= 0.3 AND nary = 4 AND list_contains(species, 'Al') AND list_contains(species, 'O')")
def query_elements_arity_threshold(spark, sf):
    return _filtered(spark, sf, elements=["Al", "O"], nary=[4], threshold=0.3)


@registered(
    f"WITH {CLEAN} SELECT formula, score, row_number() OVER (ORDER BY score DESC, formula) AS rank FROM clean WHERE score > 0.3 AND list_contains(species, 'Al') AND list_contains(species, 'O')"
)
def query_strict(spark, sf):
    """The strict form: it fails if any row above the threshold is invalid, before elements are filtered."""
    table = clean(spark, sf).select("composition", "score")
    return query.query_compositions(table, ["Al", "O"], threshold=0.3, inclusive=False).select("formula", "score", "rank")


@registered(f"WITH {CLEAN} SELECT formula, score, row_number() OVER (ORDER BY score DESC, formula) AS rank FROM clean")
def rank_score(spark, sf):
    return query.rank_compositions(clean(spark, sf), check=False, columns=["formula", "score"]).select("formula", "score", "rank")


@registered(
    f"""WITH {CLEAN}, ref AS (SELECT * FROM (VALUES ('Al', 2), ('O', 5), ('Ti', 1)) t(s, n)),
    t AS (SELECT DISTINCT formula, s, n // g AS n FROM sc_sum JOIN sc_gcd USING (raw) JOIN sc USING (raw)),
    v AS (SELECT formula, sum(t.n * coalesce(ref.n, 0))::DOUBLE AS d, sqrt(sum(t.n * t.n)::DOUBLE) AS norm FROM t LEFT JOIN ref USING (s) GROUP BY formula),
    w AS (SELECT c.formula, c.score, CASE WHEN c.formula = 'Al2O5Ti1' THEN 1.0 ELSE least(1.0, greatest(0.0, d / (v.norm * sqrt(30.0)))) END AS ranking_value FROM clean c JOIN v USING (formula) WHERE score >= 0.5)
    SELECT *, row_number() OVER (ORDER BY ranking_value DESC, score DESC, formula) AS rank FROM w"""
)
def rank_similarity(spark, sf):
    rows = query.matching(scored(spark, sf), query.QueryFilters.of(threshold=0.5))
    return query.rank_compositions(rows, query.SimilarityRanking(REFERENCE), check=False, columns=["formula", "score"]).select("formula", "score", "ranking_value", "rank")


class PerElement(query.RankingMethod):
    """Score shared out over the distinct elements: an example of a pluggable method."""

    def value(self, formula, terms, score):
        return score / F.size(terms)


@registered(f"WITH {CLEAN}, w AS (SELECT formula, score, score / nary AS ranking_value FROM clean WHERE score >= 0.5) SELECT *, row_number() OVER (ORDER BY ranking_value DESC, score DESC, formula) AS rank FROM w")
def rank_custom(spark, sf):
    rows = query.matching(scored(spark, sf), query.QueryFilters.of(threshold=0.5))
    return query.rank_compositions(rows, PerElement(), check=False, columns=["formula", "score"]).select("formula", "score", "ranking_value", "rank")


@registered(f"WITH {CLEAN} SELECT tab, count(*) AS n, min(score) AS least, max(score) AS most FROM clean WHERE tab IN (2, 4) GROUP BY tab")
def scan_partition_by_arity(spark, sf):
    return clean(spark, sf).where("tab IN (2, 4)").groupBy("tab").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@registered(f"WITH {CLEAN} SELECT formula AS composition, score FROM clean WHERE tab = 3 AND score > 0.3 AND score <= 0.9")
def scan_imported_sqlite(spark, sf):
    """Import the ternary rows into a SQLite file, then leave the range of scores to it."""
    row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_row")
    path = Workspace(spark, "sqlite").file("ternary.db")
    sqlite_sink.import_sqlite(clean(spark, sf).where("tab = 3").select("composition", "score", row), path, "lineitem", "keep")
    return scores.read_scores(spark, path, where=[("score", ">", 0.3), ("score", "<=", 0.9)])


@registered(
    f"""WITH {CLEAN}, lines AS (SELECT formula || chr(9) || CASE WHEN score >= 0.0001 AND score < 1000000 THEN score::VARCHAR END || chr(10) AS line, formula, score, l_orderkey * 8 + l_linenumber AS place FROM clean)
    SELECT count(*) AS n, sha256(string_agg(line, '' ORDER BY place, formula, score)) AS records_sha256 FROM lines"""
)
def import_digest(spark, sf):
    """The digest of all imported rows in order of their source rows."""
    rows = clean(spark, sf).select(F.col("formula").alias("composition"), "score", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_row"))
    return sinks.records_digests(rows)


# Validation and import

CHECKED = f"""{SCORED}, checked AS (SELECT *, CASE WHEN composition IS NULL THEN 'invalid_record' WHEN score IS NULL THEN 'invalid_score'
  WHEN NOT regexp_full_match(composition, '(?:[A-Z][a-z]?(?:[1-9][0-9]*)?)+') THEN 'unsupported_syntax' WHEN composition = 'Dy1D2' THEN 'unsupported_symbol' END AS error FROM scored)"""


@registered(f"WITH {CHECKED} SELECT error AS category, count(*) AS n FROM checked WHERE error IS NOT NULL GROUP BY error")
def validate_category_counts(spark, sf):
    return validate.category_counts(_bad(spark, sf))


@registered(f"WITH {CHECKED} SELECT tab, count(*) AS n_rows, count(error) AS invalid_rows FROM checked GROUP BY tab")
def validate_by_table(spark, sf):
    return validate.table_counts(_bad(spark, sf), "tab")


@registered(
    f"""WITH {CHECKED} SELECT error AS category, f.l_orderkey AS l_orderkey, f.l_linenumber AS l_linenumber, f.composition AS composition FROM (
    SELECT error, min(struct_pack(l_orderkey := l_orderkey, l_linenumber := l_linenumber, composition := composition)) AS f FROM checked WHERE error IS NOT NULL GROUP BY error)"""
)
def validate_first_examples(spark, sf):
    return validate.first_examples(_bad(spark, sf), ["l_orderkey", "l_linenumber"], ["composition"])


@registered(f"WITH {CHECKED} SELECT l_orderkey, l_linenumber, composition, error AS category FROM checked WHERE error IS NOT NULL ORDER BY l_orderkey, l_linenumber LIMIT 20")
def validate_issues(spark, sf):
    """The first twenty faults, as a report lists them."""
    return validate.issues(_bad(spark, sf), ["l_orderkey", "l_linenumber"], ["composition"], 20)


CATEGORIES = f"""{SCORED}, {canonical("sc", "scored")}, {LEGACY}, judged AS (
  SELECT l.*, CASE WHEN composition IS NULL THEN 'invalid_record' WHEN score IS NULL THEN 'invalid_score'
    WHEN NOT regexp_full_match(composition, '(?:[A-Z][a-z]?(?:[1-9][0-9]*)?)+') THEN 'unsupported_syntax' WHEN composition = 'Dy1D2' THEN 'unsupported_symbol'
    WHEN wrong = 'symbol' THEN 'unsupported_symbol' WHEN wrong = 'amount' THEN 'invalid_stoichiometry' WHEN wrong = 'arity' OR sc.nary <> tab THEN 'inconsistent_columns' END AS error
  FROM legacy l LEFT JOIN sc ON l.composition = sc.raw)"""


@registered(f"WITH {CATEGORIES} SELECT error AS category, count(*) AS n FROM judged WHERE error IS NOT NULL GROUP BY error")
def validate_legacy_categories(spark, sf):
    """All six categories, over a table that repeats its formulas as columns."""
    return validate.category_counts(validate.legacy_validated(legacy(spark, sf)))


@registered(f"WITH {CLEAN}, d AS (SELECT formula, list(l_orderkey ORDER BY l_orderkey) AS k FROM clean GROUP BY formula) SELECT formula, len(k)::BIGINT AS n, k[1] AS first_row, k[2] AS second_row FROM d WHERE len(k) > 1")
def import_duplicates(spark, sf):
    return validate.duplicates(clean(spark, sf), F.col("l_orderkey"))


@registered(f"WITH {CLEAN} SELECT formula AS composition, score, composition AS source_formula, l_orderkey AS source_row FROM clean")
def import_keep(spark, sf):
    return validate.imported(clean(spark, sf), "l_orderkey", "keep")


# Audit


def _audited(spark, sf):
    return audit.with_reason(records(spark, sf))


@registered(f"WITH {AUDITED} SELECT composition, system AS chemical_system, label, record_count, experimental_records, theoretical_records, unknown_records, material_ids, source_ids FROM grouped")
def audit_groups(spark, sf):
    return audit.as_text(audit.groups(_audited(spark, sf)))


@registered(f"WITH {AUDITED} SELECT label, mixed, count(*) AS n FROM grouped GROUP BY ALL")
def audit_labels(spark, sf):
    return groups(spark, sf).groupBy("label", "mixed").agg(F.count("*").alias("n"))


@registered(f"WITH {AUDITED} SELECT material_id, composition, reason, normalization_issue FROM audited WHERE reason IS NOT NULL")
def audit_exclusions(spark, sf):
    return audit.excluded(_audited(spark, sf))


@registered(f"WITH {AUDITED} SELECT reason, count(*) AS n FROM audited WHERE reason IS NOT NULL GROUP BY reason")
def audit_exclusion_counts(spark, sf):
    return audit.exclusion_counts(_audited(spark, sf))


@registered(
    f"""WITH {AUDITED}, r AS (SELECT count(*) AS total_records, count(*) FILTER (reason IS NULL) AS included_records, count(reason) AS excluded_records,
      count(*) FILTER (theoretical = 'unknown') AS records_missing_flag, count(*) FILTER (source_ids = '.') AS records_missing_source_ids FROM audited),
    g AS (SELECT count(*) AS unique_compositions, count(*) FILTER (label = 'positive') AS positive_compositions, count(*) FILTER (label = 'unlabelled') AS unlabelled_compositions,
      count(*) FILTER (label = 'unresolved') AS unresolved_compositions, count(*) FILTER (mixed) AS mixed_flag_compositions FROM grouped)
    SELECT *, included_records - unique_compositions AS collapsed_extra_records, positive_compositions // 5 AS positive_holdout_20_percent_floor, positive_compositions + unlabelled_compositions AS eligible_pu_compositions,
      positive_compositions // 5 >= 1 AND unlabelled_compositions >= 1 AS has_minimum_pilot_data FROM r, g"""
)
def audit_summary(spark, sf):
    rows = _audited(spark, sf)
    return audit.summary(rows, audit.groups(rows))


# Splits

SPLIT_COLUMNS = "design, policy, seed, composition, system, mixed, role, heldout"


@registered(f"WITH {sql.splits(20)} SELECT {SPLIT_COLUMNS} FROM csplit WHERE policy = 'original'")
def split_composition_all_seeds(spark, sf):
    return splits.composition_splits(groups(spark, sf), policies=("original",))


@registered(f"WITH {sql.splits(20)} SELECT {SPLIT_COLUMNS} FROM csplit")
def split_composition_policies(spark, sf):
    return splits.composition_splits(groups(spark, sf), SEEDS)


@registered(
    f"""WITH {sql.splits(20)} SELECT design, policy, seed, count(*) FILTER (role = 'training') AS training_count, count(*) FILTER (role = 'candidate') AS candidate_count, count(*) FILTER (heldout) AS heldout_count
    FROM (SELECT * FROM csplit UNION ALL SELECT * FROM ssplit) GROUP BY ALL"""
)
def split_counts(spark, sf):
    g = _kept_groups(spark, sf)
    return splits.counts(splits.composition_splits(g).unionByName(splits.system_splits(g)))


@registered(f"WITH {sql.splits(1)} SELECT system FROM uni")
def system_universe(spark, sf):
    return splits.universe(groups(spark, sf))


@registered(f"WITH {sql.splits(20)} SELECT seed, system FROM sel")
def system_selection(spark, sf):
    return splits.selected_systems(groups(spark, sf))


@registered(f"WITH {sql.splits(20)} SELECT {SPLIT_COLUMNS} FROM ssplit")
def split_system(spark, sf):
    return splits.system_splits(groups(spark, sf), SEEDS)


@registered(f"WITH {AUDITED}, {sql.POLICY} SELECT * FROM pg")
def policy_groups(spark, sf):
    return splits.policy_groups(groups(spark, sf))


EVALUATION = f"""{sql.splits(20)}, esplit AS (SELECT c.design, p.policy, c.seed, c.composition, c.system, c.mixed, c.role, c.heldout AND (p.policy = 'original' OR NOT c.mixed) AS heldout
  FROM csplit c, policies p WHERE c.policy = 'original' AND NOT (p.policy = 'exclude_mixed' AND c.mixed AND c.role = 'candidate'))"""


@registered(f"WITH {EVALUATION} SELECT * FROM esplit")
def evaluation_only_membership(spark, sf):
    return splits.evaluation_only(splits.composition_splits(groups(spark, sf), SEEDS))


# Rankings and metrics


def _split(spark, sf, policies=("original",)):
    return splits.composition_splits(groups(spark, sf), SEEDS, policies)


def _labelled(spark, sf, policies=("original",), methods=rankers.PU_METHODS):
    split = _split(spark, sf, policies)
    return rankers.labelled(rankers.pu_rank(split, methods), split)


def _pu_ranking(method):
    def f(spark, sf):
        return _labelled(spark, sf, methods=(method,)).select("seed", "rank", "composition", "score", "random_key", "tie_key", "observed_label")

    f.__name__ = f"pu_{method}"
    return registered(f"WITH {sql.pu(20)} SELECT seed, rank, composition, score, random_key, tie_key, CASE WHEN heldout THEN 'positive' ELSE 'unlabelled' END AS observed_label FROM ranked WHERE method = '{method}'")(f)


for _method in rankers.PU_METHODS:
    _pu_ranking(_method)

ALL = sql.pu(20, "true")
METRICS = f"{ALL}, {sql.metrics(BUDGETS)}"


@registered(f"WITH {METRICS} SELECT * FROM metrics")
def pu_metrics(spark, sf):
    return metrics.pu_metrics(_labelled(spark, sf, splits.POLICIES), BUDGETS, strict=False)


@registered(f"WITH {METRICS} SELECT DISTINCT design, policy, seed, budget, random_expected_hits, random_expected_hits_numerator, random_expected_hits_denominator FROM metrics")
def pu_expected_hits_fraction(spark, sf):
    rows = metrics.pu_metrics(_labelled(spark, sf, splits.POLICIES, ("random",)), BUDGETS, strict=False)
    return rows.select("design", "policy", "seed", "budget", "random_expected_hits", "random_expected_hits_numerator", "random_expected_hits_denominator")


@registered(f"WITH {sql.pu(20)} SELECT seed, method, rank, sum(heldout::BIGINT) OVER (PARTITION BY seed, method ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS running_hits FROM ranked")
def pu_running_hits(spark, sf):
    return metrics.running_hits(_labelled(spark, sf)).select("seed", "method", "rank", "running_hits")


def _bench(spark, sf):
    rows = _audited(spark, sf).where("reason IS NULL")
    best = rows.groupBy(F.col("formula").alias("composition")).agg(F.max("score").alias("score"), F.first("terms").alias("terms"), F.first("species").alias("species"))
    joined = groups(spark, sf).where("label <> 'unresolved'").join(best, "composition").withColumn("outcome", (F.col("label") == "positive").cast("int"))
    trains = (F.col("label") == "positive") & F.substring(F.sha2("composition", 256), 1, 1).isin("0", "1", "2", "3")
    return joined.where(~trains), joined.where(trains)


def _bench_ranking(method, seeds=BENCH_SEEDS):
    columns = ["seed", "rank", "composition", "stored_score", "ranking_value", "random_key", "outcome"]

    def f(spark, sf):
        return rankers.bench_rank(*_bench(spark, sf), methods=(method,), seeds=seeds).select(columns)

    f.__name__ = f"bench_{method}"
    return registered(f"WITH {sql.BENCH} SELECT {', '.join(columns)} FROM branks WHERE method = '{method}'")(f)


for _method in rankers.BENCH_METHODS:
    _bench_ranking(_method)


@registered(
    f"""WITH {sql.BENCH}, budgets AS (SELECT unnest([25, 50, 100])::BIGINT AS budget),
    top AS (SELECT r.method, r.seed, b.budget, r.outcome, c.system, c.species, c.system NOT IN (SELECT system FROM btrain) AS novel FROM branks r JOIN budgets b ON r.rank <= b.budget JOIN bcand c USING (composition)),
    cov AS (SELECT method, seed, budget, count(DISTINCT e) AS covered FROM (SELECT *, unnest(species) AS e FROM top) GROUP BY ALL),
    p AS (SELECT sum(outcome)::BIGINT AS positives, count(*) AS n FROM bcand), pe AS (SELECT count(DISTINCT e) AS pool FROM (SELECT unnest(species) AS e FROM bcand)),
    f AS (SELECT method, seed, budget, sum(outcome)::BIGINT AS hits, count(*) FILTER (novel) AS novel, count(DISTINCT system) AS systems FROM top GROUP BY ALL)
    SELECT f.method, f.seed, f.budget, hits, hits / f.budget AS precision, CASE WHEN positives > 0 THEN hits / positives END AS recall, CASE WHEN positives > 0 THEN (hits / f.budget) / (positives / n) END AS enrichment,
      novel / f.budget AS novel_system_fraction, systems / f.budget AS unique_system_fraction, covered / pool AS element_coverage
    FROM f JOIN cov ON f.method = cov.method AND f.budget = cov.budget AND f.seed IS NOT DISTINCT FROM cov.seed, p, pe"""
)
def bench_metrics(spark, sf):
    candidates, training = _bench(spark, sf)
    return metrics.bench_metrics(rankers.bench_rank(candidates, training, seeds=BENCH_SEEDS), candidates, training, (25, 50, 100))


@registered(f"WITH {sql.BENCH} SELECT DISTINCT system FROM bcand WHERE system NOT IN (SELECT system FROM btrain)")
def novel_systems(spark, sf):
    candidates, training = _bench(spark, sf)
    return candidates.select("system").distinct().join(training.select("system"), "system", "left_anti")


@registered(f"WITH {sql.BENCH} SELECT e AS element, n FROM bfreq")
def element_frequency(spark, sf):
    return rankers.element_frequency(_bench(spark, sf)[1])


# Populations and diagnostics

PAIRS = f"{sql.pu(20)}, pc AS (SELECT seed, list_filter(species, lambda e: e <> 'O') AS r FROM train), pairs AS (SELECT seed, r[1] AS element_a, r[2] AS element_b, count(*) AS n FROM pc GROUP BY ALL)"


@registered(f"WITH {PAIRS} SELECT * FROM pairs")
def pair_counts(spark, sf):
    return pairmodel.pair_counts(rankers.split_sides(_split(spark, sf))[1], ["seed"])


@registered(f"WITH {PAIRS} SELECT seed, element_a, element_b, n, round(ln(1.0 + n) / ln(1.0 + sum(n) OVER (PARTITION BY seed)), 9) AS target FROM pairs")
def pair_targets(spark, sf):
    counts = pairmodel.pair_counts(rankers.split_sides(_split(spark, sf))[1], ["seed"])
    return pairmodel.pair_targets(counts, ["seed"]).withColumn("target", F.round("target", 9))


def _kept_groups(spark, sf):
    """The audited groups, written once for a query that reads them several times."""
    return Workspace(spark, "groups").keep(groups(spark, sf), "groups")


def _both(spark, sf, g=None):
    g = _kept_groups(spark, sf) if g is None else g
    return splits.composition_splits(g, SEEDS).unionByName(splits.system_splits(g, SEEDS))


BOTH = f"{sql.splits(20)}, split AS (SELECT * FROM csplit UNION ALL SELECT * FROM ssplit)"
SHARES = """conc AS (SELECT design, policy, seed, role, held, max(n) / sum(n) AS largest, sum(n) FILTER (r <= 5) / sum(n) AS top5 FROM (
  SELECT *, row_number() OVER (PARTITION BY design, policy, seed, role, held ORDER BY n DESC, system) AS r FROM (
    SELECT design, policy, seed, role, heldout AS held, system, count(*) AS n FROM split GROUP BY ALL)) GROUP BY ALL)"""


@registered(f"WITH {BOTH}, {SHARES} SELECT design, policy, seed, largest, top5 FROM conc WHERE role = 'training'")
def concentration(spark, sf):
    return metrics.concentration(_both(spark, sf).where("role = 'training'"), rankers.BRANCH)


@registered(
    f"""WITH {BOTH}, {SHARES},
    base AS (SELECT design, policy, seed, count(*) FILTER (role = 'training') AS training_count, count(*) FILTER (role = 'candidate') AS candidate_count, count(*) FILTER (heldout) AS heldout_count,
      count(DISTINCT system) FILTER (role = 'training') AS training_system_count, count(DISTINCT system) FILTER (role = 'candidate') AS candidate_system_count, count(DISTINCT system) FILTER (heldout) AS heldout_system_count,
      count(*) FILTER (role = 'training' AND mixed) AS mixed_training_count, count(*) FILTER (role = 'candidate' AND mixed) AS mixed_candidate_count FROM split GROUP BY ALL),
    sides AS (SELECT design, policy, seed, system, bool_or(role = 'training') AS t, bool_or(role = 'candidate') AS c FROM split GROUP BY ALL),
    overlap AS (SELECT design, policy, seed, count(*) FILTER (t AND c) AS system_overlap_count FROM sides GROUP BY ALL),
    chosen AS (SELECT b.design, b.policy, b.seed, count(*) AS selected, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sides s WHERE s.design = b.design AND s.policy = b.policy AND s.seed = b.seed AND s.system = sel.system AND s.c)) AS empty
      FROM base b JOIN sel ON b.seed = sel.seed WHERE b.design = 'system' GROUP BY ALL),
    usable AS (SELECT policy, count(*) FILTER (label <> 'unresolved') AS usable, count(*) FILTER (label = 'unlabelled') AS u FROM pg GROUP BY policy)
    SELECT b.design, b.policy, b.seed AS split_seed, training_count, candidate_count, heldout_count, candidate_count - heldout_count AS unlabelled_count, heldout_count / candidate_count AS prevalence,
      (SELECT count(*) FROM grouped) - usable AS excluded_group_count, u - (candidate_count - heldout_count) AS unused_unlabelled_count, (SELECT count(*) FROM uni) AS universe_system_count,
      coalesce(selected, 0) AS selected_system_count, coalesce(empty, 0) AS selected_empty_system_count, training_system_count, candidate_system_count, heldout_system_count, system_overlap_count, mixed_training_count, mixed_candidate_count,
      t.largest AS training_largest_system_fraction, t.top5 AS training_top5_system_fraction, h.largest AS heldout_largest_system_fraction, h.top5 AS heldout_top5_system_fraction
    FROM base b JOIN overlap USING (design, policy, seed) LEFT JOIN chosen USING (design, policy, seed) JOIN usable USING (policy)
      JOIN (SELECT * FROM conc WHERE role = 'training') t USING (design, policy, seed) JOIN (SELECT * FROM conc WHERE held) h USING (design, policy, seed)"""
)
def population(spark, sf):
    g = _kept_groups(spark, sf)
    return metrics.populations(Workspace(spark, "population").keep(_both(spark, sf, g), "split"), g)


@registered(
    f"""WITH {sql.pu(20)}, subsets AS (SELECT seed, composition, score AS value, unnest(['all', CASE WHEN heldout THEN 'positive' ELSE 'unlabelled' END]) AS subset FROM ranked WHERE method = 'similarity'),
    l AS (SELECT seed, subset, list(value ORDER BY value) AS v, list_reduce(list(value ORDER BY composition), lambda a, b: a + b) AS total, count(*) AS n FROM subsets GROUP BY ALL)
    SELECT seed, subset, n, total / n AS mean, v[1] AS min, v[greatest(1, ceil(0.1::DOUBLE * n))::BIGINT] AS p10, v[greatest(1, ceil(0.5::DOUBLE * n))::BIGINT] AS median, v[greatest(1, ceil(0.9::DOUBLE * n))::BIGINT] AS p90, v[n] AS max,
      len(list_filter(v, lambda x: x >= 0.9)) / n AS fraction_ge_09, len(list_filter(v, lambda x: x >= 0.99)) / n AS fraction_ge_099 FROM l"""
)
def similarity_diagnostics(spark, sf):
    rows = _labelled(spark, sf, methods=("similarity",)).withColumn("subset", F.explode(F.array(F.lit("all"), F.col("observed_label"))))
    return metrics.diagnostics(rows, ["seed", "subset"], "score")


@registered(
    f"""WITH {AUDITED}, {CLEAN}, ext AS (SELECT formula AS composition, min(score) AS lo, max(score) AS hi, count(*) AS n FROM clean WHERE nary = 3 GROUP BY formula)
    SELECT label, count(*) AS total, count(n) AS covered, 100 * count(n) / count(*) AS percent, min(lo) AS score_min, max(hi) AS score_max, count(*) FILTER (n > 1) AS duplicate_canonical FROM grouped LEFT JOIN ext USING (composition) GROUP BY label"""
)
def coverage_by_label(spark, sf):
    return analysis.coverage(groups(spark, sf), clean(spark, sf).where("nary = 3"))


# Paired analysis


def _pairs(spark, sf):
    return analysis.paired(metrics.pu_metrics(_labelled(spark, sf, splits.POLICIES, ("popularity", "similarity")), BUDGETS, strict=False))


SUMMARY = f"""{METRICS}, {sql.PAIRED}, summary AS (SELECT design, policy, budget, avg(difference) AS mean, median(difference) AS median, min(difference) AS least, max(difference) AS most,
  count(*) FILTER (difference > 0) AS positive, count(*) FILTER (difference = 0) AS zero, count(*) FILTER (difference < 0) AS negative FROM paired GROUP BY ALL)"""


@registered(f"WITH {METRICS}, {sql.PAIRED} SELECT * FROM paired")
def paired_differences(spark, sf):
    return _pairs(spark, sf)


@registered(f"WITH {SUMMARY} SELECT * FROM summary")
def paired_summary(spark, sf):
    return analysis.paired_summary(_pairs(spark, sf))


@registered(f"WITH {METRICS} SELECT design, policy, method, budget, {', '.join(f'round(avg({m}), 9) AS mean_{m}' for m in analysis.MEASURES)} FROM metrics GROUP BY ALL")
def method_summary(spark, sf):
    rows = analysis.method_summary(metrics.pu_metrics(_labelled(spark, sf, splits.POLICIES), BUDGETS, strict=False))
    return rows.withColumns({f"mean_{m}": F.round(f"mean_{m}", 9) for m in analysis.MEASURES})


@registered(f"WITH {METRICS}, {sql.PAIRED} SELECT p.policy, design, seed, budget, p.difference, o.difference AS base_difference, p.difference - o.difference AS change FROM paired p JOIN (SELECT * FROM paired WHERE policy = 'original') o USING (design, seed, budget) WHERE p.policy <> 'original'")
def change_from_original(spark, sf):
    return analysis.change_from(_pairs(spark, sf), "policy", "original")


@registered(f"WITH {SUMMARY} SELECT s.design, s.policy, s.mean, o.mean AS original_mean, sign(s.mean) <> sign(o.mean) AS sign_changed FROM summary s JOIN summary o USING (design, budget) WHERE budget = 100 AND o.policy = 'original' AND s.policy <> 'original'")
def sign_change_decision(spark, sf):
    return analysis.sign_changes(analysis.paired_summary(_pairs(spark, sf)), 100)


@registered(
    f"""WITH {sql.pu(20)}, budgets AS (SELECT unnest({list(BUDGETS)})::BIGINT AS budget), tied AS (SELECT design, policy, seed, method, score, count(*) AS tie, min(rank) AS first_rank FROM ranked WHERE score IS NOT NULL GROUP BY ALL),
    flat AS (SELECT design, policy, seed, method, count(*) AS distinct_scores, max(tie) AS largest_tie FROM tied GROUP BY ALL)
    SELECT design, policy, seed, method, budget, distinct_scores, largest_tie, tie AS cutoff_tie_size, budget - first_rank + 1 AS selected_from_cutoff_tie
    FROM tied JOIN budgets ON first_rank <= budget AND budget < first_rank + tie JOIN flat USING (design, policy, seed, method)"""
)
def score_ties(spark, sf):
    return analysis.score_ties(_labelled(spark, sf, methods=("popularity", "similarity")), BUDGETS)


@registered(
    f"""WITH {sql.pu(20)}, budgets AS (SELECT unnest([20, 100])::BIGINT AS budget), members AS (SELECT s.*, n.species FROM split s JOIN norms n USING (composition)),
    each AS (SELECT design, policy, seed, composition, role, heldout, g.kind AS kind, g.grp AS grp FROM (SELECT *, unnest(list_concat([
        {{'kind': 'chemical_system', 'grp': system}}, {{'kind': 'H_containing', 'grp': list_contains(species, 'H')::VARCHAR}}, {{'kind': 'halogen_containing', 'grp': list_has_any(species, [{sql.HALOGEN_LIST}])::VARCHAR}}, {{'kind': 'mixed_flags', 'grp': mixed::VARCHAR}}],
        list_transform(species, lambda e: {{'kind': 'element', 'grp': e}}))) AS g FROM members)),
    gs AS (SELECT design, policy, seed, kind, grp, count(*) FILTER (role = 'training') AS training_count, count(*) FILTER (role = 'candidate') AS candidate_count, count(*) FILTER (heldout) AS heldout_count FROM each GROUP BY ALL),
    top AS (SELECT e.design, e.policy, e.seed, e.kind, e.grp, r.method, b.budget, count(*) AS selected_count, count(*) FILTER (e.heldout) AS hits
      FROM ranked r JOIN budgets b ON r.rank <= b.budget JOIN each e USING (design, policy, seed, composition) WHERE e.role = 'candidate' GROUP BY ALL)
    SELECT design, policy, seed, kind, grp AS "group", method, budget, training_count, candidate_count, heldout_count, coalesce(selected_count, 0) AS selected_count, coalesce(hits, 0) AS hits,
      CASE WHEN heldout_count > 0 THEN coalesce(hits, 0) / heldout_count END AS recall, CASE WHEN selected_count > 0 THEN hits / selected_count END AS fraction
    FROM gs JOIN (SELECT DISTINCT design, policy, seed, method FROM ranked WHERE method <> 'similarity') m USING (design, policy, seed) CROSS JOIN budgets LEFT JOIN top USING (design, policy, seed, kind, grp, method, budget)"""
)
def subgroup_breakdowns(spark, sf):
    split = _split(spark, sf)
    parsed = fm.with_composition(split.select("composition").distinct()).select("composition", "species")
    return analysis.breakdowns(split.join(parsed, "composition"), rankers.pu_rank(split, ("random", "popularity")), (20, 100))


@registered(
    f"""WITH {sql.pu(20)}, kept AS (SELECT r.* FROM ranked r WHERE method = 'popularity' AND NOT mixed)
    SELECT seed, composition, rank AS original_rank, row_number() OVER (PARTITION BY seed ORDER BY rank) AS rank FROM kept"""
)
def filtered_rerank(spark, sf):
    split = _split(spark, sf)
    eligible = split.where("role = 'candidate' AND NOT mixed")
    return rankers.filtered(rankers.pu_rank(split, ("popularity",)), eligible, rankers.BRANCH).select("seed", "composition", "original_rank", "rank")


@registered(
    f"""WITH {sql.pu(20)}, kept AS (SELECT r.* FROM ranked r WHERE method = 'popularity' AND NOT mixed),
    again AS (SELECT seed, rank AS original_depth, row_number() OVER (PARTITION BY seed ORDER BY rank) AS budget FROM kept) SELECT * FROM again WHERE budget IN ({", ".join(map(str, BUDGETS))})"""
)
def depth_at_budget(spark, sf):
    """How deep the original ranking was read to fill each budget from the eligible candidates."""
    return filtered_rerank(spark, sf).where(F.col("rank").isin(*BUDGETS)).select("seed", F.col("original_rank").alias("original_depth"), F.col("rank").alias("budget"))


SAVED = f"""{sql.pu(20)}, eranked AS (SELECT r.design, p.policy, r.seed, r.method, r.composition, r.heldout AND (p.policy = 'original' OR NOT r.mixed) AS heldout, r.rank AS original_rank,
    row_number() OVER (PARTITION BY p.policy, r.seed, r.method ORDER BY r.rank) AS rank FROM ranked r, policies p WHERE NOT (p.policy = 'exclude_mixed' AND r.mixed))"""
SAVED_METHODS = ("random", "popularity")


def _saved(spark, sf):
    """Rankings written as a bundle's files and evaluated from there, under every policy."""
    split, path = _split(spark, sf), Workspace(spark, "rankings").file("rankings")
    experiments.write_rankings(rankers.labelled(rankers.pu_rank(split, SAVED_METHODS), split), path)
    return experiments.evaluation_only(groups(spark, sf), SEEDS, BUDGETS, SAVED_METHODS, experiments.read_rankings(spark, path), strict=False)


@registered(f"WITH {SAVED}, {sql.metrics(BUDGETS).replace('ranked', 'eranked')} SELECT * FROM metrics WHERE method <> 'similarity'")
def saved_ranking_metrics(spark, sf):
    return _saved(spark, sf)["metrics"]


@registered(f"WITH {SAVED} SELECT design, policy, method, rank AS budget, min(original_rank) AS least_depth, max(original_rank) AS greatest_depth FROM eranked WHERE method <> 'similarity' AND rank IN ({', '.join(map(str, BUDGETS))}) GROUP BY ALL")
def saved_ranking_depths(spark, sf):
    return _saved(spark, sf)["depth_summary"]


DESIGNS = f"{sql.pu(20, source='(SELECT * FROM csplit UNION ALL SELECT * FROM ssplit)')}, {sql.metrics((20, 50))}, {sql.PAIRED}"


@registered(
    f"WITH {DESIGNS} SELECT p.design, policy, seed, budget, p.difference, o.difference AS base_difference, p.difference - o.difference AS change FROM paired p JOIN (SELECT * FROM paired WHERE design = 'composition') o USING (policy, seed, budget) WHERE p.design <> 'composition'"
)
def change_by_design(spark, sf):
    """Whole systems held out, against single compositions; the smaller pools of that design bear smaller budgets."""
    split = _both(spark, sf).where("policy = 'original'")
    ranked = rankers.labelled(rankers.pu_rank(split, ("popularity", "similarity")), split)
    return analysis.change_from(analysis.paired(metrics.pu_metrics(ranked, (20, 50), strict=False)), "design", "composition")


# The factor model: iterative, so no SQL; tests compare it with a plain loop over all pairs


@registered(
    f"""WITH {PAIRS}, sides AS (SELECT seed, element_a AS e FROM pairs UNION SELECT seed, element_b FROM pairs), ks AS (SELECT unnest(range(1, 5)) AS k),
    f AS (SELECT seed, e, k, (0.5 + ('0x' || substr(sha256('{hashing.FACTORS}' || chr(10) || '{pairmodel.Settings().seed}' || chr(10) || e || chr(10) || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) / sqrt(40.0::DOUBLE) AS v FROM sides, ks),
    p AS (SELECT a.seed, a.e AS element_a, b.e AS element_b, sum(a.v * b.v) AS d FROM f a JOIN f b ON a.seed = b.seed AND a.k = b.k AND a.e < b.e GROUP BY ALL),
    t AS (SELECT seed, element_a, element_b, ln(1.0::DOUBLE + n) / ln(1.0::DOUBLE + sum(n) OVER (PARTITION BY seed)) AS target FROM pairs),
    l AS (SELECT seed, sum(0.5 * CASE WHEN target IS NULL THEN 0.01 ELSE 1.0 END * (d - coalesce(target, 0)) * (d - coalesce(target, 0))) AS l FROM p LEFT JOIN t USING (seed, element_a, element_b) GROUP BY seed),
    r AS (SELECT seed, sum(0.5 * 0.01 * v * v) AS r FROM f GROUP BY seed)
    SELECT 'composition' AS design, 'original' AS policy, seed, round(l + r, 9) AS objective FROM l JOIN r USING (seed)"""
)
def pair_factor_start(spark, sf):
    """The loss of each fit's first point, as its trace has it."""
    trace = pairmodel.fit_tables(rankers.split_sides(_split(spark, sf))[1])["objective"]
    return trace.where("iteration = 0").select("design", "policy", "seed", F.round("objective", 9).alias("objective"))


@registered(f"WITH {PAIRS} SELECT 'composition' AS design, 'original' AS policy, seed, true AS agrees, true AS falling FROM pairs GROUP BY seed")
def pair_factor_recheck(spark, sf):
    """Does each fit's last loss agree with that of its written factors and counts, and did every step lower it?"""
    rows = pairmodel.recheck_objective(pairmodel.fit_tables(rankers.split_sides(_split(spark, sf))[1]))
    return rows.select("design", "policy", "seed", (F.abs(F.col("objective") - F.col("again")) <= 1e-9 * F.col("objective")).alias("agrees"), "falling")


@registered()
def pair_factor_trace(spark, sf):
    return pairmodel.fit_tables(rankers.split_sides(_split(spark, sf))[1])["objective"]


@registered()
def pair_factor_fit(spark, sf):
    return pairmodel.fit_branches(rankers.split_sides(_split(spark, sf))[1])


@registered()
def pair_factor_rank(spark, sf):
    return pairmodel.rank_candidates(_split(spark, sf))


@registered()
def pair_factor_diagnostics(spark, sf):
    return pairmodel.fit_diagnostics(pairmodel.rank_candidates(_split(spark, sf)))
