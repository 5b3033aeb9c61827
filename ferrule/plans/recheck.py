"""A second derivation of a written experiment, in SQL over its text alone: ranks, keys, ties, metrics, differences and summaries.

Nothing here uses the operators that made the files. Each check is a query for offending rows, and its first finding
names the file.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import hashing
from ..operators.query import InvalidRecords
from ..sources.tsv import read_tsv

RANKING = ["design", "policy", "seed", "method", "rank", "composition", "score", "random_key", "tie_key", "heldout", "observed_label"]
METRICS = ["design", "policy", "seed", "method", "budget", "hits", "candidate_count", "heldout_count", "observed_label_fraction", "heldout_recall", "observed_label_enrichment", "random_expected_hits", "random_expected_hits_numerator", "random_expected_hits_denominator"]
PAIRED = ["design", "policy", "seed", "budget", "similarity", "popularity", "difference"]
SUMMARY = ["design", "policy", "budget", "mean", "median", "least", "most", "positive", "zero", "negative"]
MEANS = ["hits", "observed_label_fraction", "heldout_recall", "observed_label_enrichment", "random_expected_hits", "candidate_count", "heldout_count"]
METHODS = ["design", "policy", "method", "budget", *[f"mean_{c}" for c in MEANS]]
SIZES = ["training_count", "candidate_count", "heldout_count", "unlabelled_count", "prevalence", "excluded_group_count", "unused_unlabelled_count", "universe_system_count", "selected_system_count", "selected_empty_system_count"]
SYSTEMS = ["training_system_count", "candidate_system_count", "heldout_system_count", "system_overlap_count", "mixed_training_count", "mixed_candidate_count"]
FRACTIONS = [f"{side}_{what}_system_fraction" for side in ("training", "heldout") for what in ("largest", "top5")]
POPULATION = ["design", "policy", "split_seed", *SIZES, *SYSTEMS, *FRACTIONS]
BRANCH = "design, policy, seed, method"


def _key(domain: str, seed: str) -> str:
    return f"sha2(concat('{domain}', char(10), {seed}, char(10), composition), 256)"


#: (file, what is wrong, offending rows). Texts are compared as numbers only where they are numbers.
CHECKS = [
    ("ranking", "a row is no entry", "SELECT * FROM {r} WHERE rank IS NULL OR rank < 1 OR seed IS NULL OR flag IS NULL OR (method = 'random') <> (score IS NULL) OR (method = 'random') <> (random_key <> '')"),
    ("ranking", "ranks have gaps or repeats", f"SELECT {BRANCH} FROM {{r}} GROUP BY {BRANCH} HAVING count(*) <> max(rank) OR count(DISTINCT rank) <> count(*) OR count(DISTINCT composition) <> count(*)"),
    ("ranking", "a label says otherwise than its flag", "SELECT * FROM {r} WHERE observed_label <> CASE WHEN flag THEN 'positive' ELSE 'unlabelled' END"),
    ("ranking", "a tie key is not its composition's", f"SELECT * FROM {{r}} WHERE tie_key <> {_key(hashing.PU_TIE, str(hashing.TIE_SEED))}"),
    ("ranking", "a random key is not its composition's", f"SELECT * FROM {{r}} WHERE method = 'random' AND random_key <> {_key(hashing.PU_RANDOM, f'(seed + {hashing.RANKING_SEED})')}"),
    ("ranking", "two rows stand the wrong way round", """SELECT a.* FROM {r} a JOIN {r} b ON a.design = b.design AND a.policy = b.policy AND a.seed = b.seed AND a.method = b.method AND b.rank = a.rank + 1
        WHERE b.score > a.score OR (b.score <=> a.score AND struct(b.random_key, b.tie_key, b.composition) < struct(a.random_key, a.tie_key, a.composition))"""),
    ("ranking", "methods of a branch rank different candidates or labels", "SELECT design, policy, seed, composition FROM {r} GROUP BY design, policy, seed, composition HAVING count(*) <> (SELECT count(DISTINCT method) FROM {r}) OR count(DISTINCT flag) <> 1"),
    ("metrics", "the grid of branches, methods and budgets has gaps or repeats", f"SELECT {BRANCH} FROM {{m}} GROUP BY {BRANCH} HAVING count(*) <> (SELECT count(DISTINCT budget) FROM {{m}}) OR count(DISTINCT budget) <> count(*)"),
    ("metrics", "branches are not those of the ranking", f"(SELECT DISTINCT {BRANCH} FROM {{m}} EXCEPT SELECT {BRANCH} FROM {{r}}) UNION ALL (SELECT DISTINCT {BRANCH} FROM {{r}} EXCEPT SELECT {BRANCH} FROM {{m}})"),
    ("metrics", "a number is not what the ranking gives", f"""WITH t AS (SELECT {BRANCH}, count(*) AS n, count_if(flag) AS h FROM {{r}} GROUP BY {BRANCH}),
        k AS (SELECT m.*, t.n, t.h FROM {{m}} m JOIN t USING ({BRANCH})),
        g AS (SELECT {BRANCH}, k.budget, count_if(flag) AS found FROM k JOIN {{r}} r USING ({BRANCH}) WHERE r.rank <= k.budget GROUP BY {BRANCH}, k.budget)
        SELECT k.* FROM k LEFT JOIN g USING ({BRANCH}, budget) WHERE NOT (hits <=> found AND candidate_count <=> n AND heldout_count <=> h AND observed_label_fraction <=> found / budget AND heldout_recall <=> found / h
          AND observed_label_enrichment <=> (found / budget) / (h / n) AND random_expected_hits <=> (budget * h) / n
          AND random_expected_hits_numerator * n <=> random_expected_hits_denominator * budget * h AND random_expected_hits_denominator > 0
          AND NOT exists(sequence(2, least(10000, random_expected_hits_denominator)), d -> random_expected_hits_denominator % d = 0 AND random_expected_hits_numerator % d = 0))"""),
    ("method_summary", "a mean is not that of the metrics", f"""WITH w AS (SELECT design, policy, method, budget, {", ".join(f"avg({c}) AS w_{c}" for c in MEANS)} FROM {{m}} GROUP BY ALL)
        SELECT * FROM w FULL JOIN {{a}} a USING (design, policy, method, budget) WHERE NOT ({" AND ".join(f"coalesce(abs(mean_{c} - w_{c}) <= 1e-12 * greatest(1, abs(w_{c})), false)" for c in MEANS)})"""),
    ("population", "counts are not those of the ranking", """WITH w AS (SELECT design, policy, seed, count(*) AS n, count_if(flag) AS h FROM {r} WHERE method = (SELECT min(method) FROM {r}) GROUP BY ALL)
        SELECT * FROM w FULL JOIN {o} o ON o.design = w.design AND o.policy = w.policy AND o.split_seed = w.seed WHERE NOT (candidate_count <=> n AND heldout_count <=> h AND unlabelled_count <=> n - h AND prevalence <=> h / n)"""),
    ("population", "counts do not add up", """SELECT * FROM {o} WHERE NOT coalesce(training_count > 0 AND mixed_training_count BETWEEN 0 AND training_count AND mixed_candidate_count BETWEEN 0 AND candidate_count AND training_system_count BETWEEN 1 AND training_count
        AND candidate_system_count BETWEEN 1 AND candidate_count AND heldout_system_count BETWEEN 1 AND heldout_count AND system_overlap_count BETWEEN 0 AND least(training_system_count, candidate_system_count) AND excluded_group_count >= 0 AND unused_unlabelled_count >= 0
        AND selected_empty_system_count BETWEEN 0 AND selected_system_count AND selected_system_count <= universe_system_count AND training_top5_system_fraction BETWEEN training_largest_system_fraction AND 1 AND heldout_top5_system_fraction BETWEEN heldout_largest_system_fraction AND 1
        AND abs(training_largest_system_fraction * training_count - round(training_largest_system_fraction * training_count)) < 1e-6 AND abs(heldout_largest_system_fraction * heldout_count - round(heldout_largest_system_fraction * heldout_count)) < 1e-6, false)"""),
    ("paired", "a difference is not that of the metrics", """WITH w AS (SELECT design, policy, seed, budget, max(CASE WHEN method = 'similarity' THEN hits END) AS s, max(CASE WHEN method = 'popularity' THEN hits END) AS p FROM {m} GROUP BY ALL)
        SELECT * FROM w FULL JOIN {p} p USING (design, policy, seed, budget) WHERE NOT (w.s <=> p.similarity AND w.p <=> p.popularity AND p.difference <=> w.s - w.p)"""),
    ("paired_summary", "a summary is not that of the differences", """WITH w AS (SELECT design, policy, budget, avg(difference) AS a, median(difference) AS b, min(difference) AS c, max(difference) AS d, count_if(difference > 0) AS e, count_if(difference = 0) AS f, count_if(difference < 0) AS g FROM {p} GROUP BY ALL)
        SELECT * FROM w FULL JOIN {s} s USING (design, policy, budget) WHERE NOT (abs(s.mean - a) <= 1e-12 * greatest(1, abs(a)) AND s.median <=> b AND s.least <=> c AND s.most <=> d AND s.positive <=> e AND s.zero <=> f AND s.negative <=> g)"""),
]


def _typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Texts as numbers; what is no number becomes null, and then fails a check."""
    return df.selectExpr(*[f"try_cast({c} AS {kinds[c]}) AS {c}" if c in kinds else c for c in df.columns])


def recheck(spark: SparkSession, path: str | Path) -> int:
    """The number of checks that a written experiment passes; InvalidRecords names the first that fails."""
    text = lambda name, columns: read_tsv(spark, f"{path}/{name}.tsv", columns, filled=False).select(columns)
    whole = dict.fromkeys(("seed", "rank", "budget", "hits", "candidate_count", "heldout_count", "random_expected_hits_numerator", "random_expected_hits_denominator"), "bigint")
    real = dict.fromkeys(("score", "observed_label_fraction", "heldout_recall", "observed_label_enrichment", "random_expected_hits", "mean", "median"), "double")
    counts = dict.fromkeys(("similarity", "popularity", "difference", "least", "most", "positive", "zero", "negative"), "bigint")
    kinds = whole | real | counts | dict.fromkeys(["split_seed", *SIZES, *SYSTEMS], "bigint") | dict.fromkeys(["prevalence", *FRACTIONS, *METHODS[4:]], "double")
    ranking = _typed(text("ranking", RANKING), **kinds)
    ranking = ranking.selectExpr("*", "CASE heldout WHEN 'true' THEN true WHEN 'false' THEN false END AS flag")
    tables = {"r": ranking, "m": _typed(text("metrics", METRICS), **kinds), "a": _typed(text("method_summary", METHODS), **kinds), "o": _typed(text("population", POPULATION), **kinds)}
    if (Path(path) / "paired.tsv").is_file():
        tables |= {"p": _typed(text("paired", PAIRED), **kinds), "s": _typed(text("paired_summary", SUMMARY), **kinds)}
    passed = 0
    for name, wrong, query in CHECKS:
        needs = {k: tables.get(k) for k in "rmaops" if f"{{{k}}}" in query}
        if None in needs.values():
            continue
        found = spark.sql(query, **needs).limit(1).collect()
        if found:
            raise InvalidRecords(f"{name}.tsv: {wrong}: {found[0].asDict()}")
        passed += 1
    return passed
