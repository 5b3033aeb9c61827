"""Text files from tasks: the same bytes as a plain loop makes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators.query import InvalidRecords
from ferrule.sources import texts
from ferrule.sources.texts import write_texts
from ferrule.sources.tsv import read_tsv


def test_bytes_are_those_of_a_plain_loop(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice([None, "a", "É", "x;y"]), r.choice([None, 0.1, 1e-9, 2.0]), i % 3 == 0, [1, None, i], f"f{i % 4}/part.tsv") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, score double, flag boolean, list array<int>, file string").repartition(7)
    made = write_texts(df, tmp_path, F.col("file"), ["name", "id"], ["id", "name", "score", "flag", "list"], ["f0/part.tsv", "empty.tsv"])
    for f in range(4):
        mine = sorted((x for x in rows if x[5] == f"f{f}/part.tsv"), key=lambda x: (x[1] is not None, (x[1] or "").encode(), x[0]))
        text = "id\tname\tscore\tflag\tlist\n" + "".join(texts.line(x[:5]) for x in mine)
        assert (tmp_path / f"f{f}/part.tsv").read_bytes() == text.encode()
        assert made[f"f{f}/part.tsv"] == (len(mine), hashlib.sha256(text.encode()).hexdigest())
    assert (tmp_path / "empty.tsv").read_text() == "id\tname\tscore\tflag\tlist\n" and made["empty.tsv"][0] == 0
    assert {p.name for p in tmp_path.iterdir()} == {"f0", "f1", "f2", "f3", "empty.tsv"} and {p.name for p in (tmp_path / "f0").iterdir()} == {"part.tsv"}
    with pytest.raises(FileExistsError):
        write_texts(df, tmp_path, F.col("file"), ["id"])


def test_raw_lines_and_bad_cells(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\tc"), (1, "a"), (3, "")], "n long, text string")
    assert write_texts(df, tmp_path, "raw.txt", ["n"], ["text"], header=False)["raw.txt"][0] == 3
    assert (tmp_path / "raw.txt").read_text() == "a\nb\tc\n\n"
    with pytest.raises(Exception, match="tab or line end"):
        write_texts(df, tmp_path, "bad.tsv", ["n"])
    with pytest.raises(ValueError, match="one column"):
        write_texts(df, tmp_path, "bad.tsv", ["n"], header=False)
    assert [p.name for p in tmp_path.iterdir()] == ["raw.txt"]
    assert write_texts(df.limit(0), tmp_path, "none.tsv", ["n"])["none.tsv"][0] == 0 and (tmp_path / "none.tsv").read_text() == "n\ttext\n"


def test_tables_name_their_own_columns(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("id\tname\n1\ta\n2\t\n")
    rows = read_tsv(spark, str(path), None, filled=False).orderBy("source_row")
    assert rows.columns == ["source_row", "id", "name"] and [tuple(r) for r in rows.collect()] == [(1, "1", "a"), (2, "2", "")]
    with pytest.raises(InvalidRecords, match="row 2"):
        read_tsv(spark, str(path), None)
    for head in ("id\tID\n", "id\t\n", "source_row\tid\n", ""):
        path.write_text(head)
        with pytest.raises(InvalidRecords):
            read_tsv(spark, str(path), None)
