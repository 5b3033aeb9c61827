"""The benchmark's and the audit's reports: every file, its hashes, and refusals that leave nothing."""

import io
import json
import tomllib

from ferrule import cli
from ferrule.plans import baseline


def test_report_has_every_file(spark, tmp_path):
    names = ["Li1Na1O1", "Li2Na1O1", "K1Na1O1", "K2Na1O1", "Mg1O1", "Ca1O1", "Fe1O1", "Fe2O3"]
    (tmp_path / "c.tsv").write_text("composition\tscore\toutcome\n" + "".join(f"{c}\t{1 - k / 10}\t{int(k % 3 == 0)}\n" for k, c in enumerate(names)))
    (tmp_path / "t.tsv").write_text("composition\nLi1O1\nNa2O1\n")
    out = tmp_path / "report"
    args = ["benchmark", "--input", str(tmp_path / "c.tsv"), "--training", str(tmp_path / "t.tsv"), "--output", str(out), "--source", "test", "--budget", "2", "4", "--seeds", "0", "1"]
    assert cli.main(args) == 0
    assert {p.name for p in out.iterdir()} == {"input.tsv", "training.tsv", "candidates.csv", "metrics.json", "benchmark.md", "config.toml"}
    assert (out / "input.tsv").read_bytes() == (tmp_path / "c.tsv").read_bytes()
    config = tomllib.loads((out / "config.toml").read_text())
    assert (config["candidate_count"], config["positive_count"], config["training_count"], config["budgets"], config["seeds"]) == (8, 3, 2, [2, 4], [0, 1])
    assert set(baseline.verified_files(out)) == {"input.tsv", "training.tsv", "candidates.csv", "metrics.json", "benchmark.md"}
    rows = [x.split(",") for x in (out / "candidates.csv").read_text().splitlines()]
    assert rows[0] == ["method", "seed", "rank", "composition", "stored_score", "ranking_value", "outcome"] and len(rows) == 1 + 8 * 4
    score = [r for r in rows if r[0] == "score"]
    assert [r[3] for r in score] == names and [r[2] for r in score] == [str(k + 1) for k in range(8)] and {r[1] for r in score} == {""}
    measured = json.loads((out / "metrics.json").read_text())["metrics"]
    assert len(measured) == 4 * 2 and [m["hits"] for m in measured if m["method"] == "score"] == [1, 2] and [m["recall"] for m in measured if m["method"] == "score"] == [1 / 3, 2 / 3]
    assert "| score | - | 4 | 2 | 0.5000 |" in (out / "benchmark.md").read_text()
    assert cli.main(args) == 2
    (tmp_path / "t.tsv").write_text("composition\nLi1O1\nMg2O2\n")  # shared with the candidates
    assert cli.main([x.replace("report", "other") for x in args]) == 2 and not (tmp_path / "other").exists()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c.tsv", "report", "t.tsv"]


def test_audit_split_experiment_replay_and_recheck(spark, tmp_path):
    """From documents to a checked experiment by the commands alone."""
    symbols = "Li Na K Rb Cs Mg Ca Sr Ba Al".split()
    docs = [{"material_id": f"mp-{n}", "composition": {a: 1 + n % 3, b: 1, "O": 1 + n % 4}, "theoretical": n % 3 > 0, "database_IDs": {"icsd": [str(n)]}} for n, (a, b) in enumerate((a, b) for a in symbols for b in symbols if a < b)]
    (tmp_path / "docs.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs))
    at = lambda name: str(tmp_path / name)
    call = lambda *args: cli.main(list(args))
    assert call("snapshot", "--documents", at("docs.jsonl"), "--output", at("snap"), "--database-version", "test") == 0
    assert call("audit", "--snapshot", at("snap/records.jsonl"), "--metadata", at("snap/snapshot.toml"), "--table", at("snap/records.tsv"), "--output", at("audit")) == 0
    assert {p.name for p in (tmp_path / "audit").iterdir()} == {"compositions.tsv", "excluded.tsv", "audit.toml", "audit.md", "snapshot.toml"}
    summary = tomllib.loads((tmp_path / "audit/audit.toml").read_text())
    assert summary["total_records"] == len(docs) and summary["positive_compositions"] == 15 and "**Synthetic" in (tmp_path / "audit/audit.md").read_text()
    for name, digest in summary["files"].items():
        assert baseline.file_sha256(tmp_path / "audit" / name) == digest
    groups = ["--groups", at("audit/compositions.tsv")]
    assert call("split", *groups, "--output", at("bundle"), "--seeds", "0", "1", "--budget", "2") == 0
    assert call("experiment", *groups, "--bundle", at("bundle"), "--output", at("run"), "--seeds", "0", "1", "--budget", "2") == 0
    out = io.StringIO()
    assert cli.run(cli.parser().parse_args(["recheck", "--run", at("run")]), out) == 0 and "checks passed" in out.getvalue()
    assert call("replay", *groups, "--run", at("run")) == 0
    text = (tmp_path / "run/metrics.tsv").read_text()
    (tmp_path / "run/metrics.tsv").write_text(text.replace("original", "Original", 1))
    assert call("replay", *groups, "--run", at("run")) == 2 and call("recheck", "--run", at("run")) == 2
