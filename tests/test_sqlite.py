"""SQLite files: filters that reach them, and imports in two phases."""

import hashlib
import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ferrule import cli
from ferrule.operators import query
from ferrule.sources import scores, sinks, sqlite_sink

ROWS = [("MgO", 0.5), ("LiO", 0.1), ("NaO", "high"), ("KO", None), (None, 0.7), ("CaO", 0.9), ("mgo", 0.5), ("MgO", 3)]
WHERE = [
    [("score", ">=", 0.5)], [("score", ">", 0.5)], [("score", "<", 0.5)], [("score", "<=", 0.1)], [("score", "=", 0.9)], [("score", "in", [0.1, 3.0])], [("composition", "=", "MgO")], [("composition", "in", ["LiO", "KO"])],
    [("score", ">", 0.2), ("composition", "=", "MgO")], [("score", "<", float("inf"))], [("composition", ">", "L")], [],
]


@pytest.fixture(scope="module")
def standard(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sqlite") / "standard.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (composition TEXT COLLATE NOCASE, score REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?)", ROWS)
    return path


@pytest.fixture(scope="module")
def legacy(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sqlite") / "legacy.db")
    with sqlite3.connect(path) as db:
        for name, n in (("data2", 2), ("data3", 3), ("data4ionic", 4)):
            db.execute(f"CREATE TABLE {name} (composition TEXT, score REAL, {', '.join(f'ele{i} TEXT, int{i} INTEGER' for i in range(1, n + 1))})")
            for k in range(5):
                db.execute(f"INSERT INTO {name} (composition, score, ele1, int1) VALUES (?, ?, 'Mg', ?)", (f"Mg{n}O{k}", k / 4, k))
    return path


@pytest.mark.parametrize("where", WHERE)
def test_filters_give_what_spark_gives(spark, standard, where):
    plain = spark.createDataFrame([(c, float(s) if isinstance(s, (int, float)) else None) for c, s in ROWS], "composition string, score double")
    for comparison in where:
        plain = plain.where(scores.compared(*comparison))
    found = scores.read_scores(spark, standard, where=where)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_filters_reach_the_file(spark, standard, legacy):
    plan = scores.read_scores(spark, standard, where=[("score", ">=", 0.5), ("composition", "=", "MgO")]).where("composition LIKE '%O'")
    text = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(score,0.5), EqualTo(composition,MgO)" in text and "Filter" in text  # LIKE '%O' stays with Spark
    reader = scores.ScoreReader(standard, 3, scores.Pushed(), [["score", ">", 0.4]])
    rest = list(reader.pushFilters([ds.GreaterThan(("score",), 0.4), ds.GreaterThan(("score",), 0.6), ds.StringContains(("composition",), "O"), ds.Not(ds.EqualTo(("score",), 0.5))]))
    assert len(rest) == 3
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(reader.partitions()) == 3 and all(isinstance(b, pa.RecordBatch) for b in batches) and sum(b.num_rows for b in batches) == 5  # the rows that SQLite handed over
    reader = scores.ScoreReader(legacy, 100, scores.Pushed(), [["nary", ">", 2], ["score", "<", 0.3]])
    assert list(reader.pushFilters([ds.IsNotNull(("nary",)), ds.GreaterThan(("nary",), 2), ds.LessThan(("score",), 0.3)]))[0].attribute == ("nary",)
    assert [p.name for p in reader.partitions()] == ["data3", "data4ionic"] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    rows = scores.read_scores(spark, legacy).collect()
    for where, keeps in (([("nary", "=", 3)], lambda r: r["nary"] == 3), ([("nary", "in", [2, 4]), ("score", ">", 0.5)], lambda r: r["nary"] in (2, 4) and r["score"] > 0.5), ([("nary", ">", 9)], lambda r: False)):
        assert sorted(map(str, scores.read_scores(spark, legacy, where=where).collect())) == sorted(str(r) for r in rows if keeps(r))
    with pytest.raises(ValueError, match="comparison"):
        scores.read_scores(spark, legacy, where=[("score", "<>", 1)])


def test_one_plan_leaves_another_alone(spark, standard):
    """Other filters over one relation, one after another and within a plan, take nothing from each other."""
    rows = scores.read_scores(spark, standard)
    high, low = rows.where("score > 0.6"), rows.where("score < 0.2")
    assert (high.count(), rows.count(), low.count(), high.union(low).count(), rows.union(low).count()) == (3, 8, 1, 4, 9)
    some = scores.read_scores(spark, standard, where=[("score", ">=", 0.5)])
    assert (some.where("score > 0.8").count(), some.count(), some.where("score < 0.6").union(some.where("score > 0.8")).count()) == (2, 5, 4)


@pytest.mark.parametrize(("x", "text"), [(1e-5, "1.0e-5"), (1e-4, "0.0001"), (1e6, "1.0e6"), (999999.5, "999999.5"), (1234567.0, "1.234567e6"), (-2.5e-7, "-2.5e-7"), (1e100, "1.0e100"), (5e-324, "5.0e-324"), (0.0, "0.0"), (-0.0, "-0.0"), (0.1, "0.1")])
def test_score_texts(x, text):
    assert sinks.score_text(x) == text and float(text) == x


def many(spark, n):
    return spark.range(1, n + 1, 1, 3).select(F.col("id").alias("source_row"), F.concat(F.lit("Mg"), F.col("id"), F.lit("O1")).alias("composition"), (F.col("id") / 1e7).alias("score"))


@pytest.mark.parametrize("n", [0, 1, 10, 65_536, 65_537, 1_000_000])
def test_digest_is_that_of_the_whole_text_at_any_size(spark, n):
    want = hashlib.sha256("".join(f"Mg{i}O1\t{sinks.score_text(i / 1e7)}\n" for i in range(1, n + 1)).encode()).hexdigest()
    found = sinks.records_digests(many(spark, n).repartition(5)).first()
    assert tuple(found) == (n, want)


def test_import_is_read_back(spark, tmp_path):
    r, path = random.Random(4), str(tmp_path / "made.db")
    given = [(n, f"Mg{2 * (n % 7) + 2}O2", r.choice([1e-6, 0.25, 0.5])) for n in range(1, 400)]
    r.shuffle(given)
    table = spark.createDataFrame(given, "source_row long, composition string, score double").repartition(6)
    with pytest.raises(query.InvalidRecords, match="repeats"):
        sqlite_sink.import_sqlite(table, path, "test")
    made = sqlite_sink.import_sqlite(table, path, "test", "keep")
    assert [p.name for p in tmp_path.iterdir()] == ["made.db"]
    with sqlite3.connect(path) as db:
        rows = db.execute("SELECT source_row, composition, score, source_formula FROM compositions ORDER BY rowid").fetchall()
        assert [x[0] for x in rows] == list(range(1, 400)) and [(a, d, c) for a, _, c, d in rows] == sorted(given)
        assert dict(db.execute("SELECT * FROM import_metadata")) == made and made["row_count"] == "399"
        assert {x[0] for x in db.execute("SELECT name FROM sqlite_master WHERE type = 'index' AND name LIKE 'compositions%'")} == {"compositions_formula_idx", "compositions_score_idx"}
        assert made["records_sha256"] == hashlib.sha256("".join(f"{c}\t{sinks.score_text(s)}\n" for _, c, s, _ in rows).encode()).hexdigest()
    scores.quick_check(path)
    back = scores.read_scores(spark, path)
    query.require_valid(query.validated(back))
    assert back.where("score = 0.25").count() == sum(s == 0.25 for _, _, s in given)
    for again in (path, str(tmp_path / "none" / "x.db")):
        with pytest.raises(OSError):
            sqlite_sink.import_sqlite(table, again, "test", "keep")
    (tmp_path / "broken.db").symlink_to(tmp_path / "nowhere")
    with pytest.raises(FileExistsError):
        sqlite_sink.import_sqlite(table, str(tmp_path / "broken.db"), "test", "keep")


def test_killed_tasks_leave_nothing(spark, tmp_path):
    """A task that dies halfway ends the write without a file; shards that no task reported are not read."""
    target = tmp_path / "killed.db"
    spark.dataSource.register(sqlite_sink.ImportSink)
    bad = many(spark, 3000).select("composition", F.when(F.col("source_row") == 2900, F.raise_error(F.lit("lost"))).otherwise(F.col("score")).alias("score"), F.col("composition").alias("source_formula"), "source_row")
    with pytest.raises(Exception, match="lost"):
        bad.write.format("sqlite_import").option("path", str(target)).option("metadata", "{}").mode("append").save()
    assert list(tmp_path.iterdir()) == []

    rows = [("Mg1O1", 0.5, "MgO", 1), ("Li1O1", 1e-7, "LiO", 2)]
    metadata = {"row_count": "2", "duplicate_policy": "error", "records_sha256": sqlite_sink.lines_digest([x[:2] for x in rows])}
    batch = lambda some: pa.RecordBatch.from_pylist([dict(zip(sqlite_sink.COLUMNS, x, strict=True)) for x in some])

    def broken():
        yield batch(rows)
        raise RuntimeError("lost")

    writer = sqlite_sink.ImportWriter(str(target), metadata)
    with pytest.raises(RuntimeError):
        writer.write(broken())
    second, first = writer.write(iter([batch(rows[1:])])), writer.write(iter([batch(rows[:1])]))
    empty = writer.write(iter([]))
    assert len(list(writer.staging.iterdir())) == 4
    writer.commit([second, None, first, empty])
    with sqlite3.connect(target) as db:
        assert db.execute("SELECT * FROM compositions ORDER BY rowid").fetchall() == rows
    assert [p.name for p in tmp_path.iterdir()] == ["killed.db"]

    other = sqlite_sink.ImportWriter(str(tmp_path / "other.db"), metadata | {"records_sha256": "0" * 64})
    with pytest.raises(query.InvalidRecords, match="digest"):
        other.commit([other.write(iter([batch(rows)]))])
    late = sqlite_sink.ImportWriter(str(target), metadata)
    with pytest.raises(FileExistsError):
        late.commit([late.write(iter([batch(rows)]))])
    assert [p.name for p in tmp_path.iterdir()] == ["killed.db"]


def test_command_line_imports_sqlite(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("composition\tscore\nMgO\t0.5\nAlSiO\t0.25\n")
    path = str(tmp_path / "s.db")
    assert cli.main(["import", "--input", str(tmp_path / "s.tsv"), "-d", path, "--source", "test"]) == 0
    assert cli.main(["validate", "-d", path]) == 0
    assert cli.main(["import", "--input", str(tmp_path / "s.tsv"), "-d", path, "--source", "test"]) == 2
