"""Formulas, queries, validation, sources and sinks."""

import hashlib
import io
import json
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from ferrule import cli
from ferrule.functions import formula as fm
from ferrule.functions.elements import SYMBOLS
from ferrule.functions.formula import Composition
from ferrule.operators import query, validate
from ferrule.operators.numbering import numbered, running_sum
from ferrule.sources import jsonl, scores, sinks, tsv

BIG = "9223372036854775807"
REJECTED = {"": "unsupported_syntax", "mg2Zn": "unsupported_syntax", "Xx2": "unsupported_symbol", "Mg0": "unsupported_syntax", "Mg01": "unsupported_syntax", "2Mg": "unsupported_syntax"}
REJECTED |= {"Mg1.5Zn": "unsupported_syntax", "Mg(OH)2": "unsupported_syntax", "Mg\n": "unsupported_syntax", "Mg₂": "unsupported_syntax", f"Mg{BIG}Mg": "invalid_record", "Mg99999999999999999999": "invalid_record"}


def test_canonical_forms_agree_on_both_sides(spark):
    r = random.Random(4)
    texts = ["NaCl", "MgMgZn", "O2", "Mg2Zn2", f"Mg{BIG}", "Fe36O48", "H64O96", "Zn1Mg1"]
    texts += ["".join(r.choice(SYMBOLS) + str(r.randint(1, 120)) for _ in range(r.randint(1, 6))) for _ in range(200)]
    rows = fm.with_composition(spark.createDataFrame([(t,) for t in texts], "composition string")).withColumn("norm", fm.norm(F.col("terms"))).collect()
    for row in rows:
        want = Composition(row["composition"])
        assert (row["formula"], tuple(row["species"]), row["nary"], row["system"]) == (want.formula, want.species, len(want), "-".join(want.species))
        assert row["formula_error"] is None and math.isclose(row["norm"], want.norm, rel_tol=1e-12)
    by = {row["composition"]: row["formula"] for row in rows}
    assert (by["NaCl"], by["MgMgZn"], by["O2"], len(SYMBOLS)) == ("Cl1Na1", "Mg2Zn1", "O1", 118)


def test_rejects_by_category(spark):
    rows = fm.with_composition(spark.createDataFrame([(t,) for t in [*REJECTED, None]], "composition string")).collect()
    assert {r["composition"]: r["formula_error"] for r in rows} == REJECTED | {None: "invalid_record"}
    assert all(r["formula"] is None and r["nary"] is None for r in rows)
    for text in REJECTED:
        with pytest.raises(ValueError):
            Composition(text)
    for amount in (True, 0, -1, 1.0, 1 << 63):
        with pytest.raises(ValueError):
            Composition({"Mg": amount})


def test_scaling_and_order_do_not_matter():
    r = random.Random(7)
    for _ in range(100):
        base = {s: r.randint(1, 9) for s in r.sample(SYMBOLS, r.randint(1, 5))}
        scaled = list(base.items())
        r.shuffle(scaled)
        k = r.randint(1, 7)
        assert Composition(base) == Composition({s: k * n for s, n in scaled}) and hash(Composition(base)) == hash(Composition(dict(scaled)))


def test_similarity_values(spark):
    assert math.isclose(Composition("MgZn").similarity(Composition("Mg2Zn")), 3 / math.sqrt(10)) and Composition("MgZn").similarity(Composition("AlO")) == 0
    df = fm.with_composition(spark.createDataFrame([("Mg2Zn", 1.0), ("Mg4Zn2", 0.5), ("AlO", 0.9)], "composition string, score double"))
    ranked = query.rank_by_similarity(df, "MgZn").orderBy("rank").collect()
    assert [r["formula"] for r in ranked] == ["Mg2Zn1", "Mg2Zn1", "Al1O1"] and ranked[0]["ranking_value"] == 3 / math.sqrt(10)


TABLE = [("Al2Si1O4", 0.9), ("MgZn", 0.3), ("Mg2Zn2", 0.3), ("AlSiO", 0.5), ("SiAlOH", 0.5), ("LiO", 0.001), ("Fe2O3", 0.7)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(TABLE, "composition string, score double")


def test_query_semantics(table, spark):
    names = lambda **k: [r["formula"] for r in query.query_compositions(table, **k).orderBy("rank").collect()]
    assert names() == ["Al2O4Si1", "Fe2O3", "Al1H1O1Si1", "Al1O1Si1", "Mg1Zn1", "Mg1Zn1"]
    assert names(elements=["Al", "Si"], nary=[3]) == ["Al2O4Si1", "Al1O1Si1"] and names(nary=[]) == []
    assert names(threshold=0.7) == ["Al2O4Si1", "Fe2O3"] and names(threshold=0.7, inclusive=False) == ["Al2O4Si1"]
    for bad in ({"elements": "Al"}, {"elements": ["Xx"]}, {"nary": [True]}, {"nary": [0]}, {"threshold": float("nan")}, {"threshold": True}):
        with pytest.raises(ValueError):
            query.query_compositions(table, **bad)
    for faulty in (("Xx2", 0.9), (None, 0.9), ("MgO", None), ("MgO", float("inf"))):
        with pytest.raises(query.InvalidRecords):
            query.query_compositions(table.union(spark.createDataFrame([faulty], table.schema)), elements=["Fe"])
    below = table.union(spark.createDataFrame([("Xx2", 0.001)], table.schema))
    assert query.query_compositions(below, elements=["Fe"]).count() == 1


def test_numbered_matches_a_global_window(spark):
    r = random.Random(1)
    rows = [(r.choice([0.5, r.random()]), f"f{i:04d}", r.choice(["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, f string, k string")
    order = [F.desc("v"), F.asc("f")]
    want = {x: i + 1 for i, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))}
    assert all(want[tuple(g)[:3]] == g["rank"] for g in numbered(df, order).collect())
    for k in ("a", "b", None):
        mine = {x: i + 1 for i, x in enumerate(sorted((x for x in rows if x[2] == k), key=lambda x: (-x[0], x[1])))}
        assert {tuple(g)[:3]: g["place"] for g in numbered(df, order, ["k"], "place").where(F.col("k").eqNullSafe(F.lit(k))).collect()} == mine
    sums, so_far = {}, {}
    for x in sorted(rows, key=lambda x: (-x[0], x[1])):
        sums[x] = so_far[x[2]] = so_far.get(x[2], 0) + len(x[1].strip("f0"))
    assert {tuple(g)[:3]: g["sum"] for g in running_sum(df, order, ["k"], F.length(F.expr("trim(BOTH 'f0' FROM f)")).cast("long"), "sum").collect()} == sums
    plan = numbered(df, order)._jdf.queryExecution().toString()
    assert "Window" not in plan and numbered(df.where("false"), order, ["k"]).count() == 0


def test_custom_ranking_must_be_finite(table):
    class Broken(query.RankingMethod):
        def value(self, formula, terms, score):
            return F.lit(float("inf"))

    with pytest.raises(query.InvalidRecords):
        query.rank_compositions(query.validated(table), Broken())


def test_sqlite_standard_and_legacy(spark, tmp_path):
    path = str(tmp_path / "a%b#.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE compositions (composition TEXT NOT NULL, score REAL NOT NULL)")
        db.executemany("INSERT INTO compositions VALUES (?, ?)", TABLE)
    assert scores.database_info(path) == {"schema": "standard", "tables": [("compositions", None, False)]}
    assert sorted(map(tuple, scores.read_scores(spark, path).collect())) == sorted(TABLE)
    legacy = str(tmp_path / "legacy.sqlite")
    with sqlite3.connect(legacy) as db:
        db.execute("CREATE TABLE data2 (composition TEXT, ele1 TEXT, ele2 TEXT, int1 INTEGER, int2 INTEGER, score REAL)")
        db.execute("CREATE TABLE data3 (composition TEXT, ele1 TEXT, ele2 TEXT, ele3 TEXT, int1 INTEGER, int2 INTEGER, int3 INTEGER, score REAL)")
        db.executemany("INSERT INTO data2 VALUES (?,?,?,?,?,?)", [("MgO", "Mg", "O", 1, 1, 0.4), ("Mg2O", "Mg", "O", 1, 1, 0.4), ("LiO", "Li", "Xx", 1, 1, 0.4), ("LiF", "Li", "F", 1, 0, 0.2)])
        db.execute("INSERT INTO data3 VALUES ('AlSiO', 'Al', 'Si', 'O', 1, 1, 1, 0.8)")
    rows = scores.read_scores(spark, legacy)
    found = {r["composition"]: r["error"] for r in validate.legacy_validated(rows).collect()}
    assert found == {"MgO": None, "Mg2O": "inconsistent_columns", "LiO": "unsupported_symbol", "LiF": "invalid_stoichiometry", "AlSiO": None}
    assert query.query_compositions(rows, ["Al"], legacy=True).count() == 1
    (tmp_path / "no.db").write_text("plain text that is no database")
    (tmp_path / "torn.db").write_bytes(scores.MAGIC + b"x" * 500)
    for name in ("no.db", "torn.db"):
        with pytest.raises(ValueError):
            scores.database_info(str(tmp_path / name))
    scores.quick_check(path)
    for filters in ({"threshold": 0.3, "inclusive": False, "nary": [3], "elements": ["Al"]}, {"threshold": 0.4}, {"nary": []}, {"elements": ["Mg"], "threshold": 0.0}):
        wanted = query.QueryFilters.of(**filters)
        pushed, plain = (query.filtered_scan(x, wanted, True).collect() for x in (scores.read_scores(spark, legacy, wanted), rows))
        assert sorted(map(tuple, pushed)) == sorted(map(tuple, plain))
    assert scores.read_scores(spark, legacy, query.QueryFilters.of(elements=["Al"], threshold=0.5)).count() == 1


def test_sqlite_layouts_that_are_ambiguous_or_odd(spark, tmp_path):
    def database(name, *statements):
        with sqlite3.connect(tmp_path / name) as db:
            for x in statements:
                db.execute(x)
        return str(tmp_path / name)

    two = "CREATE TABLE {} (composition TEXT, ele1 TEXT, ele2 TEXT, int1 INTEGER, int2 INTEGER, score REAL)"
    both = database("both.db", two.format("DATA2"), "CREATE TABLE scores (composition TEXT, score REAL)")
    with pytest.raises(ValueError, match="several"):
        scores.database_info(both)
    assert scores.database_info(database("upper.db", two.format("DATA2"))) == {"schema": "legacy", "tables": [("DATA2", 2, False)]}
    zero = database("zero.db", "CREATE TABLE t (composition TEXT, score REAL)", "INSERT INTO t (rowid, composition, score) VALUES (0, 'MgO', 0.5)")
    keyed = database("keyed.db", "CREATE TABLE t (composition TEXT PRIMARY KEY, score REAL) WITHOUT ROWID", "INSERT INTO t VALUES ('MgO', 0.5), ('LiO', 'high')")
    empty = database("empty.db", "CREATE TABLE t (composition TEXT, score REAL)")
    assert [scores.read_scores(spark, x).count() for x in (zero, keyed, empty)] == [1, 2, 0]
    assert scores.read_scores(spark, keyed, query.QueryFilters.of(threshold=0.9)).collect()[0]["score"] is None
    assert cli.notes(database("ionic.db", two.format("data2"), "CREATE TABLE data4ionic (composition TEXT, score REAL, " + ", ".join(f"ele{i} TEXT, int{i} INTEGER" for i in range(1, 5)) + ")"), [3, 4]) == [
        "this file has no table of arity 3", "its table of arity 4 holds ionic compositions only"
    ]


def test_tsv_is_strict(spark, tmp_path):
    def put(text):
        path = tmp_path / "x.tsv"
        path.write_bytes(text.encode())
        return tsv.read_scored(spark, str(path))

    rows = put("composition\tscore\r\nMgO\t0.5\r\nLiO\t1d\r\n").orderBy("source_row").collect()
    assert [tuple(r) for r in rows] == [(1, "MgO", 0.5), (2, "LiO", None)]
    for bad in ("composition\tscores\nMgO\t1\n", "composition\tscore\nMgO\n", "composition\tscore\nMgO\t1\t2\n", "composition\tscore\n\nMgO\t1\n", "composition\tscore\n\t1\n"):
        with pytest.raises(query.InvalidRecords):
            put(bad)


def test_jsonl_keeps_types_apart(spark, tmp_path):
    docs = [{"material_id": "mp-1", "composition": {"O": 2.0, "Li": 4}, "theoretical": False, "database_IDs": {"icsd": ["b", "a", "a"]}}]
    docs += [{"material_id": f"mp-{i + 2}", "composition": c, "theoretical": None} for i, c in enumerate([None, {"D": 1}, {"O": True}, {"O": "2"}, {"O": 1.5}, {"O": 2**63}])]
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps(d) + "\n" for d in docs))
    rows = jsonl.read_jsonl(spark, str(path)).orderBy("line").collect()
    assert tuple(rows[0])[1:] == ("mp-1", "Li4O2", "false", "icsd:a;icsd:b", ".")
    assert [r["normalization_issue"] for r in rows[1:]] == ["missing_composition", "unsupported_species", "invalid_counts", "invalid_counts", "fractional_counts", "count_overflow"]
    for bad in ("\n", "[]\n", "{\n", '{"material_id": "x"}\n', json.dumps(docs[0]) + "\n" + json.dumps(docs[0]) + "\n"):
        path.write_text(bad)
        with pytest.raises(query.InvalidRecords):
            jsonl.read_jsonl(spark, str(path))


def test_import_and_sinks(spark, table, tmp_path):
    rows = table.withColumn("source_row", F.monotonically_increasing_id())
    with pytest.raises(query.InvalidRecords):
        sinks.import_scores(rows, str(tmp_path / "one"), "test")
    made = sinks.import_scores(rows, str(tmp_path / "two"), "test", "keep")
    assert made["row_count"] == "7" and spark.read.parquet(str(tmp_path / "two/compositions")).count() == 7
    assert not (tmp_path / "one").exists() and not [x for x in tmp_path.iterdir() if x.name.endswith(".part")]
    for faulty in (rows.where("false"), rows.union(spark.createDataFrame([("Xx", 0.1, 99)], "composition string, score double, source_row long"))):
        with pytest.raises(query.InvalidRecords):
            sinks.import_scores(faulty, str(tmp_path / "none"), "test", "keep")
        assert not (tmp_path / "none").exists()
    with pytest.raises(FileExistsError):
        sinks.import_scores(rows, str(tmp_path / "two"), "test", "keep")
    with pytest.raises(ValueError):
        sinks.import_scores(rows, str(tmp_path / "none"), " ", "keep")
    named = sinks.import_records(spark, [("Mg2O2", 0.5), (Composition("LiO"), 1)], str(tmp_path / "records"), "test")
    assert named["records_sha256"] == hashlib.sha256(b"Mg1O1\t0.5\nLi1O1\t1.0\n").hexdigest()
    for bad in ([("MgO",)], [("MgO", True)], [("MgO", "1")], ["MgO"], []):
        with pytest.raises(query.InvalidRecords):
            sinks.import_records(spark, bad, str(tmp_path / "none"), "test")
    repeats = spark.createDataFrame([(1, "MgO", 0.5), (2, "Mg2O2", 0.5), (3, "LiO", 0.5), (4, "LiO", 0.5), (10, "MgO", 0.5)], "source_row long, composition string, score double")
    with pytest.raises(query.InvalidRecords, match="row 2 repeats Mg1O1 of row 1"):
        validate.imported(query.validated(repeats), "source_row")
    (tmp_path / "scored.tsv").write_text("composition\tscore\nMgO\t0.5\n")
    assert sinks.import_tsv(spark, str(tmp_path / "scored.tsv"), str(tmp_path / "three"), "test")["source_sha256"] == hashlib.sha256((tmp_path / "scored.tsv").read_bytes()).hexdigest()
    sinks.write_by_arity(table, str(tmp_path / "by"))
    assert "nary=3" in str(list((tmp_path / "by").iterdir()))
    with sinks.new_directory(str(tmp_path / "new")) as d:
        sinks.write_tsv([(1, None, 0.1, True)], ["a", "b", "c", "d"], d / "t.tsv")
    assert (tmp_path / "new/t.tsv").read_text() == "a\tb\tc\td\n1\t\t0.1\ttrue\n"
    seen = sinks.inventory(tmp_path / "new")
    sinks.verify(tmp_path / "new", seen)
    (tmp_path / "new/t.tsv").write_text("tampered")
    with pytest.raises(query.InvalidRecords):
        sinks.verify(tmp_path / "new", seen)
    with pytest.raises(FileExistsError), sinks.new_directory(str(tmp_path / "new")):
        pass
    with pytest.raises(RuntimeError), sinks.new_directory(str(tmp_path / "fails")):
        raise RuntimeError
    assert not (tmp_path / "fails").exists()


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "s.tsv"
    path.write_text("composition\tscore\nMgO\t0.5\nAlSiO\t0.25\n")
    out = io.StringIO()
    assert cli.run(cli.parser().parse_args(["query", "-d", str(path), "-n", "2", "3", "--rank", "similarity", "--reference", "MgO"]), out) == 0
    assert out.getvalue() == "# Composition, Score, Similarity\nMg1O1   0.50000   1.00000\nAl1O1Si1   0.25000   0.40825\n"
    assert cli.main(["query", "-d", str(path), "--rank", "similarity"]) == 2
    path.write_text("composition\tscore\nXx\t0.5\n")
    assert cli.run(cli.parser().parse_args(["validate", "-d", str(path), "--report"]), out) == 2


def test_digest_reads_packed_blocks(spark, monkeypatch):
    """One task must read the whole text of a digest, so it reads it packed."""
    kept, keep = [], sinks.Workspace.keep
    monkeypatch.setattr(sinks.Workspace, "keep", lambda self, *a: kept.append(keep(self, *a)) or kept[-1])
    rows = [(i, f"Li{1 + i % 7}O{1 + i * 31 % 5}", (i * 7919 % 100_003) / 100_000) for i in range(5_000)]
    text = "".join(f"{c}\t{sinks.score_text(s)}\n" for _, c, s in rows).encode()
    made = sinks.records_digests(spark.createDataFrame(rows, "source_row long, composition string, score double")).first()
    assert tuple(made) == (5_000, hashlib.sha256(text).hexdigest())
    assert 2 * sum(len(r["block"]) for r in kept[0].collect()) < len(text)
