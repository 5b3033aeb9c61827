"""Tables of formulas and scores derived from the given TPC-H-like tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import SYMBOLS
from ..operators import audit
from ..operators.query import validated

#: Symbol lists of the derived formulas; their order matters.
S1 = "Li Na K Rb Cs Be Mg Ca Sr Ba Al Ga In Sc Y La Zn Cd Cu Ag".split()
S2 = "Ti Zr Hf V Nb Ta Cr Mo W Mn Fe Co Ni Si Ge Sn P As Sb B".split()
E1 = "Li Mg Al Zn Na Ca Ba Sr".split()
E2 = "Ti Si Fe Mn Zr Sn".split()
E4 = "F Cl Br N S".split()
E5 = "H K Cu".split()


def _pick(names: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (at + 1).cast("int"))


def _div(a, b: int):
    return F.call_function("div", a, F.lit(b).cast("long"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot-like records from part, with a few of every exclusion reason."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    text = lambda x: x.cast("string")
    usual = F.concat(_pick(S1, k % 20), text(1 + size % 3), _pick(S2, _div(k, 20) % 20), text(1 + _div(k, 400) % 2), F.lit("O"), text(1 + size % 4))
    raw = F.when(k % 89 == 0, "Xx1O1").when(k % 83 == 0, "Li1O1").otherwise(usual)
    flag = F.when(size % 20 < 5, "false").when(size % 20 < 18, "true").otherwise("unknown")
    sources = F.when(k % 11 == 0, ".").otherwise(F.concat(F.lit("icsd:"), text(k % 7)))
    return part.select(
        F.concat(F.lit("mp-"), text(k)).alias("material_id"), raw.alias("composition"), flag.alias("theoretical"), sources.alias("source_ids"),
        F.when(k % 97 == 0, "fractional_counts").otherwise(".").alias("normalization_issue"), (F.col("p_retailprice").cast("double") / 2000.0).alias("score"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored-score table from lineitem, of two to five elements, with bad rows; ``tab`` is its arity table."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, p, s, m, q = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    m = m % 4
    text = lambda x: x.cast("string")
    usual = F.concat(
        _pick(E1, p % 8), text(1 + q % 4), F.lit("O"), text(1 + q % 6), F.when(m >= 1, F.concat(_pick(E2, s % 6), text(1 + p % 3))).otherwise(""),
        F.when(m >= 2, F.concat(_pick(E4, o % 5), F.lit("1"))).otherwise(""), F.when(m >= 3, F.concat(_pick(E5, o % 3), F.lit("1"))).otherwise(""),
    )
    raw = F.when(o % 997 == 0, "Dy1D2").when(o % 991 == 0, "Mg01O").otherwise(usual)
    score = F.when(o % 983 == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice").cast("double") / 100000.0)
    return line.select(o.alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), raw.alias("composition"), score.alias("score"), (m + 2).alias("tab"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(scored(spark, sf_dir)).where("error IS NULL")


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table as a file with a table for each arity has it: nary, elements and amounts repeat the formula, with faults of each kind."""
    rows, o = scored(spark, sf_dir), F.col("l_orderkey")
    elements = F.regexp_extract_all("composition", F.lit("([A-Z][a-z]?)"), F.lit(1))
    amounts = F.transform(F.regexp_extract_all("composition", F.lit("[A-Z][a-z]?([0-9]*)"), F.lit(1)), lambda n: F.when(n == "", F.lit(1).cast("long")).otherwise(n.cast("long")))
    first = lambda array, value: F.transform(array, lambda x, i: F.when(i == 0, value).otherwise(x))
    return rows.select(
        "l_orderkey", "l_linenumber", "composition", "score", F.when(o % 967 == 0, F.lit(6).cast("long")).otherwise(F.col("tab")).cast("int").alias("nary"),
        F.when(o % 977 == 0, first(elements, F.lit(None).cast("string"))).otherwise(elements).alias("elements"),
        F.when(o % 971 == 0, first(amounts, F.lit(0).cast("long"))).otherwise(amounts).alias("amounts"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(composition, system, label, mixed)."""
    return audit.mixed(audit.groups(audit.with_reason(records(spark, sf_dir))))


def _at(names: list[str], at: str) -> str:
    return f"[{', '.join(repr(x) for x in names)}][({at}) + 1]"


RECORDS = f"""records AS (
  SELECT 'mp-' || p_partkey AS material_id,
    CASE WHEN p_partkey % 89 = 0 THEN 'Xx1O1' WHEN p_partkey % 83 = 0 THEN 'Li1O1' ELSE
      {_at(S1, "p_partkey % 20")} || (1 + p_size % 3) || {_at(S2, "(p_partkey // 20) % 20")} || (1 + (p_partkey // 400) % 2) || 'O' || (1 + p_size % 4) END AS composition,
    CASE WHEN p_size % 20 < 5 THEN 'false' WHEN p_size % 20 < 18 THEN 'true' ELSE 'unknown' END AS theoretical,
    CASE WHEN p_partkey % 11 = 0 THEN '.' ELSE 'icsd:' || (p_partkey % 7) END AS source_ids,
    CASE WHEN p_partkey % 97 = 0 THEN 'fractional_counts' ELSE '.' END AS normalization_issue,
    p_retailprice::DOUBLE / 2000.0 AS score
  FROM part)"""

SCORED = f"""scored AS (
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
    CASE WHEN l_orderkey % 997 = 0 THEN 'Dy1D2' WHEN l_orderkey % 991 = 0 THEN 'Mg01O' ELSE
      {_at(E1, "l_partkey % 8")} || (1 + q % 4) || 'O' || (1 + q % 6)
      || CASE WHEN m >= 1 THEN {_at(E2, "l_suppkey % 6")} || (1 + l_partkey % 3) ELSE '' END
      || CASE WHEN m >= 2 THEN {_at(E4, "l_orderkey % 5")} || '1' ELSE '' END
      || CASE WHEN m >= 3 THEN {_at(E5, "l_orderkey % 3")} || '1' ELSE '' END END AS composition,
    CASE WHEN l_orderkey % 983 = 0 THEN NULL ELSE l_extendedprice::DOUBLE / 100000.0 END AS score, (m + 2)::BIGINT AS tab
  FROM (SELECT *, l_quantity::BIGINT AS q, l_linenumber % 4 AS m FROM lineitem))"""


LEGACY = """legacy AS (SELECT *, CASE WHEN l_orderkey % 977 = 0 THEN 'symbol' WHEN l_orderkey % 971 = 0 THEN 'amount' WHEN l_orderkey % 967 = 0 THEN 'arity' END AS wrong FROM scored)"""


def canonical(name: str, table: str, column: str = "composition") -> str:
    """CTEs that end in ``name``(raw, formula, system, nary, species, norm) over the valid texts of a column."""
    known = ", ".join(repr(s) for s in SYMBOLS)
    return f"""{name}_tok AS (
  SELECT raw, unnest(regexp_extract_all(raw, '([A-Z][a-z]?)([0-9]*)', 1)) AS s, unnest(regexp_extract_all(raw, '([A-Z][a-z]?)([0-9]*)', 2)) AS d
  FROM (SELECT DISTINCT {column} AS raw FROM {table} WHERE regexp_full_match({column}, '(?:[A-Z][a-z]?(?:[1-9][0-9]*)?)+'))),
{name}_sum AS (SELECT raw, s, sum(CASE WHEN d = '' THEN 1 ELSE d::BIGINT END)::BIGINT AS n FROM {name}_tok GROUP BY raw, s),
{name}_gcd AS (SELECT raw, list_reduce(list(n), lambda a, b: gcd(a, b)) AS g FROM {name}_sum GROUP BY raw),
{name} AS (
  SELECT t.raw, string_agg(s || (n // g), '' ORDER BY s) AS formula, string_agg(s, '-' ORDER BY s) AS system, count(*)::INTEGER AS nary, list(s ORDER BY s) AS species,
    sqrt(sum((n // g) * (n // g))::DOUBLE) AS norm
  FROM {name}_sum t JOIN {name}_gcd USING (raw) GROUP BY t.raw HAVING bool_and(s IN ({known})))"""


#: Valid scored rows: formula, system, nary, species, norm, score and the row's key.
CLEAN = f"""{SCORED}, {canonical("sc", "scored")},
clean AS (SELECT sc.*, scored.* FROM scored JOIN sc ON scored.composition = sc.raw WHERE score IS NOT NULL)"""

#: Every record with its reason, and audited groups.
AUDITED = f"""{RECORDS}, {canonical("rc", "records")},
audited AS (
  SELECT r.*, rc.formula, rc.system, rc.nary, rc.species, CASE WHEN normalization_issue <> '.' THEN 'normalization_issue' WHEN formula IS NULL THEN 'unsupported_formula'
    WHEN NOT (nary = 3 AND list_contains(species, 'O')) THEN 'outside_oxygen_ternary_scope' END AS reason
  FROM records r LEFT JOIN rc ON r.composition = rc.raw),
full_groups AS (
  SELECT formula AS composition, system AS chemical_system, count(*) AS record_count, count(*) FILTER (theoretical = 'false') AS experimental_records,
    count(*) FILTER (theoretical = 'true') AS theoretical_records, count(*) FILTER (theoretical = 'unknown') AS unknown_records,
    string_agg(material_id, ';' ORDER BY material_id) AS material_ids, coalesce(string_agg(DISTINCT source_ids, ';' ORDER BY source_ids) FILTER (source_ids <> '.'), '') AS source_ids
  FROM audited WHERE reason IS NULL GROUP BY ALL),
grouped AS (SELECT composition, chemical_system AS system, CASE WHEN experimental_records > 0 THEN 'positive' WHEN unknown_records > 0 THEN 'unresolved' ELSE 'unlabelled' END AS label,
    experimental_records > 0 AND theoretical_records > 0 AS mixed, * EXCLUDE (composition, chemical_system) FROM full_groups)"""
