"""Checks between tables, bundles, generators and streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ferrule.operators import audit, splits, verify
from ferrule.operators.query import InvalidRecords
from ferrule.plans import generators
from ferrule.sources import sinks, tsv
from ferrule.streaming import sorted_out


def test_agreement_up_to_reduction(spark):
    columns = "source_row long, material_id string, composition string, theoretical string, source_ids string, normalization_issue string"
    table = spark.createDataFrame([(1, "mp-1", "MgO", "true", ".", "."), (2, "mp-2", "D2O", "true", ".", ".")], columns)
    lines = lambda *f: spark.createDataFrame([(i + 1, f"mp-{i + 1}", x, "true", ".", ".") for i, x in enumerate(f)], columns.replace("source_row", "line"))
    verify.require_agreement(table, lines("O2Mg2", "O1D2"))
    for bad in (("MgO", "D2O2"), ("MgO",), ("MgO", "D2O", "LiO")):
        with pytest.raises(InvalidRecords):
            verify.require_agreement(table, lines(*bad))
    with pytest.raises(InvalidRecords):
        verify.require_disjoint(table, table.limit(1))
    with pytest.raises(InvalidRecords):
        verify.require_metadata({"schema_version": True})
    big = "9" * 25
    with pytest.raises(InvalidRecords):  # formulas beyond 64 bits are compared as text
        verify.require_agreement(table.withColumn("composition", F.lit(f"Mg{big}")), lines(f"Li{big}", f"Mg{big}"))


def test_metadata_fits_count_and_file(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("{}\n")
    values = {"schema_version": 1, "database_version": "v", "is_synthetic": True, "redistribution_status": "none", "record_count": 1, "records_sha256": hashlib.sha256(b"{}\n").hexdigest()}
    verify.require_metadata(values, 1, str(path))
    for change, count in (({}, 2), ({"records_sha256": "0" * 64}, 1), ({"records_sha256": "x" * 64}, 1), ({"record_count": True}, 1)):
        with pytest.raises(InvalidRecords):
            verify.require_metadata(values | change, count, str(path))


def test_groups_of_one_canonical_formula_are_duplicates(spark, tmp_path):
    head = "composition\tchemical_system\tlabel\trecord_count\texperimental_records\ttheoretical_records\tunknown_records\tmaterial_ids\tsource_ids\n"
    line = "{}\tLi-Na-O\tpositive\t1\t1\t0\t0\tm\t\n"
    path = tmp_path / "g.tsv"
    path.write_text(head + line.format("Li1Na1O1") + line.format("Li1Na1O2"))
    assert tsv.read_groups(spark, str(path)).count() == 2
    path.write_text(head + line.format("Li1Na1O1") + line.format("Na2Li2O2"))
    with pytest.raises(InvalidRecords, match="duplicate"):
        tsv.read_groups(spark, str(path))


def test_bundle_round_trip_and_tampering(spark, tmp_path):
    groups = audit.mixed(audit.groups(audit.with_reason(generators.snapshot(spark, 400))))
    split = splits.composition_splits(groups, [0, 1], ("original",))
    path = str(tmp_path / "bundle")
    sinks.write_bundle(split, path, {"seeds": [0, 1]})
    assert verify.load_bundle(spark, path, split)["seeds"] == [0, 1]
    with pytest.raises(InvalidRecords):
        verify.load_bundle(spark, path, split.withColumn("heldout", ~F.col("heldout")))
    (tmp_path / "bundle/split-00/inputs/training.tsv").write_text("composition\nMg1O1\n")
    with pytest.raises(InvalidRecords):
        verify.load_bundle(spark, path, split)


def test_similarity_pool(spark):
    pool = generators.similarity_pool(spark, 30_000)
    assert 0 < pool.count() == pool.distinct().count()


def test_streams_are_sorted_out(spark, tmp_path):
    spark.createDataFrame([("MgO", 0.5), ("Xx1", 0.5), ("LiO", None)], "composition string, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("composition string, score double").parquet(str(tmp_path / "in"))
    for name, part, n in zip(("good", "bad"), sorted_out(stream), (1, 2), strict=True):
        q = part.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
