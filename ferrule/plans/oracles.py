"""DuckDB SQL that the oracles share: policies, splits, rankings and metrics over the derived groups."""

from __future__ import annotations

from ..functions import hashing
from ..functions.elements import HALOGENS
from .derived import AUDITED


def _key(domain: str, seed: str, value: str) -> str:
    return f"sha256('{domain}' || chr(10) || {seed} || chr(10) || {value})"


POLICY = """policies AS (SELECT unnest(['original', 'exclude_mixed', 'unlabel_mixed']) AS policy),
pg AS (SELECT policy, composition, system, CASE WHEN mixed AND policy = 'unlabel_mixed' THEN 'unlabelled' ELSE label END AS label, mixed
  FROM grouped, policies WHERE NOT (mixed AND policy = 'exclude_mixed'))"""


def splits(seeds: int) -> str:
    """CTEs csplit and ssplit, with selected systems ``sel``, for seeds from 0."""
    return f"""{AUDITED}, {POLICY}, seeds AS (SELECT unnest(range({seeds}))::BIGINT AS seed),
csplit AS (
  SELECT 'composition' AS design, policy, seed, composition, system, mixed, CASE WHEN label = 'positive' AND NOT held THEN 'training' ELSE 'candidate' END AS role, held AS heldout
  FROM (SELECT *, label = 'positive' AND row_number() OVER (PARTITION BY policy, seed, label ORDER BY {_key(hashing.SPLIT, "seed", "composition")}, composition)
      <= count(*) OVER (PARTITION BY policy, seed, label) // 5 AS held FROM pg, seeds WHERE label <> 'unresolved')),
uni AS (SELECT DISTINCT system FROM grouped WHERE label <> 'unresolved'),
sel AS (SELECT seed, system FROM (
  SELECT seed, system, row_number() OVER (PARTITION BY seed ORDER BY {_key(hashing.SYSTEM_SPLIT, "seed", "system")}, system) AS r, count(*) OVER (PARTITION BY seed) AS n FROM uni, seeds) WHERE r <= n // 5),
ssplit AS (
  SELECT 'system' AS design, policy, seed, composition, system, mixed, CASE WHEN label = 'positive' AND NOT inside THEN 'training' ELSE 'candidate' END AS role, inside AND label = 'positive' AS heldout
  FROM (SELECT pg.*, seeds.seed, EXISTS (SELECT 1 FROM sel WHERE sel.seed = seeds.seed AND sel.system = pg.system) AS inside FROM pg, seeds WHERE label <> 'unresolved')
  WHERE inside OR label = 'positive')"""


#: Over a table split: rankings of the three methods, with labels.
RANKS = f"""terms AS (SELECT DISTINCT formula AS composition, s, n // g AS n FROM rc_sum JOIN rc_gcd USING (raw) JOIN rc USING (raw)),
norms AS (SELECT DISTINCT formula AS composition, norm, species FROM rc),
cand AS (SELECT s.*, norm, species FROM split s JOIN norms USING (composition) WHERE role = 'candidate'),
train AS (SELECT s.*, norm, species FROM split s JOIN norms USING (composition) WHERE role = 'training'),
freq AS (SELECT design, policy, seed, e, count(*) AS n FROM (SELECT design, policy, seed, unnest(species) AS e FROM train) GROUP BY ALL),
sizes AS (SELECT design, policy, seed, count(*) AS t FROM train GROUP BY ALL),
pop AS (SELECT c.design, c.policy, c.seed, c.composition, sum(coalesce(f.n, 0))::DOUBLE / (len(any_value(c.species)) * any_value(t)) AS score
  FROM (SELECT *, unnest(species) AS e FROM cand) c JOIN sizes USING (design, policy, seed) LEFT JOIN freq f USING (design, policy, seed, e) GROUP BY ALL),
dots AS (SELECT c.design, c.policy, c.seed, c.composition, t.composition AS other, any_value(c.norm) * any_value(t.norm) AS nn, sum(a.n * b.n)::DOUBLE AS d
  FROM cand c JOIN terms a ON a.composition = c.composition JOIN train t USING (design, policy, seed) JOIN terms b ON b.composition = t.composition AND b.s = a.s GROUP BY ALL),
sim AS (SELECT design, policy, seed, composition, max(least(1.0, greatest(0.0, d / nn))) AS score FROM dots GROUP BY ALL),
unranked AS (
  SELECT design, policy, seed, 'random' AS method, composition, NULL::DOUBLE AS score, {_key(hashing.PU_RANDOM, f"(seed + {hashing.RANKING_SEED})", "composition")} AS random_key FROM cand
  UNION ALL SELECT design, policy, seed, 'popularity', composition, score, NULL FROM pop
  UNION ALL SELECT design, policy, seed, 'similarity', composition, score, NULL FROM sim),
ranked AS (
  SELECT u.*, {_key(hashing.PU_TIE, f"'{hashing.TIE_SEED}'", "composition")} AS tie_key, row_number() OVER (PARTITION BY design, policy, seed, method
    ORDER BY score DESC NULLS LAST, random_key NULLS LAST, {_key(hashing.PU_TIE, f"'{hashing.TIE_SEED}'", "composition")}, composition) AS rank, c.heldout, c.species, c.system, c.mixed
  FROM unranked u JOIN cand c USING (design, policy, seed, composition))"""


def metrics(budgets: tuple[int, ...]) -> str:
    return f"""budgets AS (SELECT unnest({list(budgets)})::BIGINT AS budget),
totals AS (SELECT design, policy, seed, method, count(*) AS candidate_count, count(*) FILTER (heldout) AS heldout_count FROM ranked GROUP BY ALL),
hits AS (SELECT design, policy, seed, method, budget, count(*) FILTER (heldout) AS hits FROM ranked JOIN budgets ON rank <= budget GROUP BY ALL),
metrics AS (SELECT design, policy, seed, method, budget, hits, candidate_count, heldout_count, hits / budget AS observed_label_fraction, hits / heldout_count AS heldout_recall,
    (hits / budget) / (heldout_count / candidate_count) AS observed_label_enrichment, (budget * heldout_count) / candidate_count AS random_expected_hits,
    budget * heldout_count // gcd(budget * heldout_count, candidate_count) AS random_expected_hits_numerator, candidate_count // gcd(budget * heldout_count, candidate_count) AS random_expected_hits_denominator
  FROM hits JOIN totals USING (design, policy, seed, method))"""


def pu(seeds: int, where: str = "policy = 'original'", source: str = "csplit") -> str:
    return f"{splits(seeds)}, split AS (SELECT * FROM {source} WHERE {where}), {RANKS}"


PAIRED = """paired AS (SELECT s.design, s.policy, s.seed, s.budget, s.hits AS similarity, p.hits AS popularity, s.hits - p.hits AS difference
  FROM (SELECT * FROM metrics WHERE method = 'similarity') s JOIN (SELECT * FROM metrics WHERE method = 'popularity') p USING (design, policy, seed, budget))"""

BENCH = f"""{AUDITED},
bscore AS (SELECT formula AS composition, max(score) AS score FROM audited WHERE reason IS NULL GROUP BY ALL),
binfo AS (SELECT DISTINCT formula AS composition, species FROM rc),
ball AS (SELECT g.composition, g.system, b.score, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS outcome, i.species, label,
    label = 'positive' AND substr(sha256(g.composition), 1, 1) IN ('0', '1', '2', '3') AS trains
  FROM grouped g JOIN bscore b USING (composition) JOIN binfo i USING (composition) WHERE label <> 'unresolved'),
bcand AS (SELECT * FROM ball WHERE NOT trains), btrain AS (SELECT * FROM ball WHERE trains),
bfreq AS (SELECT e, count(*) AS n FROM (SELECT unnest(species) AS e FROM btrain) GROUP BY e),
bpop AS (SELECT composition, sum(coalesce(n, 0))::DOUBLE / (len(any_value(species)) * (SELECT count(*) FROM btrain)) AS v FROM (SELECT *, unnest(species) AS e FROM bcand) LEFT JOIN bfreq USING (e) GROUP BY composition),
bvals AS (
  SELECT 'score' AS method, NULL::BIGINT AS seed, composition, score AS stored_score, score AS ranking_value, NULL AS random_key, outcome FROM bcand
  UNION ALL SELECT 'popularity', NULL, composition, score, v, NULL, outcome FROM bcand JOIN bpop USING (composition)
  UNION ALL SELECT 'random', seed, composition, score, NULL, {_key(hashing.BENCH_RANDOM, "seed", "composition")}, outcome FROM bcand, (SELECT unnest([0, 1, 2])::BIGINT AS seed)),
branks AS (SELECT *, row_number() OVER (PARTITION BY method, seed ORDER BY ranking_value DESC NULLS LAST, random_key NULLS LAST, composition) AS rank FROM bvals)"""

HALOGEN_LIST = ", ".join(repr(h) for h in HALOGENS)
