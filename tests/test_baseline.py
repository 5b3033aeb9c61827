"""Saved experiments: captured, replayed, checked a second time from their text."""

import shutil
import tomllib

import pytest

from ferrule.operators import audit, splits
from ferrule.operators.query import InvalidRecords
from ferrule.plans import baseline, experiments, generators, recheck

SETTINGS = {"designs": ["composition"], "policies": ["original", "exclude_mixed"], "seeds": [0, 1], "budgets": [2, 5], "methods": ["random", "popularity", "similarity"]}


@pytest.fixture(scope="module")
def groups(spark):
    return audit.mixed(audit.groups(audit.with_reason(generators.snapshot(spark, 400))))


@pytest.fixture(scope="module")
def saved(spark, groups, tmp_path_factory):
    path = tmp_path_factory.mktemp("runs") / "saved"
    made = experiments.experiment(groups, *SETTINGS.values())
    experiments.write_experiment(made, str(path), SETTINGS)
    return path


def copy(saved, tmp_path):
    return shutil.copytree(saved, tmp_path / "copy")


def test_capture_holds_each_content_once(saved, tmp_path):
    inventory = baseline.capture(saved, tmp_path / "store", lambda name: name.startswith(("metrics", "paired")))
    assert set(inventory) == {"config.toml", "metrics.tsv", "paired.tsv", "paired_summary.tsv"}
    assert {p.name for p in (tmp_path / "store/objects").iterdir()} == set(inventory.values())
    assert baseline.captured(tmp_path / "store", "metrics.tsv").read_bytes() == (saved / "metrics.tsv").read_bytes()
    with pytest.raises(InvalidRecords, match="nothing"):
        baseline.captured(tmp_path / "store", "ranking.tsv")
    held = tmp_path / "store/objects" / inventory["metrics.tsv"]
    held.write_bytes(held.read_bytes() + b"x")
    with pytest.raises(InvalidRecords, match="another hash"):
        baseline.captured(tmp_path / "store", "metrics.tsv")
    with pytest.raises(FileExistsError):
        baseline.capture(saved, tmp_path / "store")


@pytest.mark.parametrize("name", ["../outside.tsv", "/etc/hosts", "a\\b.tsv", "", "a/../metrics.tsv", "./metrics.tsv"])
def test_unsafe_names_are_refused(saved, tmp_path, name):
    path = copy(saved, tmp_path)
    config = (path / "config.toml").read_text()
    (path / "config.toml").write_text(config + f"{name!r} = '{'0' * 64}'\n")
    with pytest.raises(InvalidRecords, match="unsafe"):
        baseline.verified_files(path)
    assert not (tmp_path / "store").exists()


def test_tampered_missing_linked_and_unnamed_files_are_refused(saved, tmp_path):
    path = copy(saved, tmp_path)
    text = (path / "metrics.tsv").read_bytes()
    (path / "metrics.tsv").write_bytes(text.replace(b"original", b"Original", 1))
    with pytest.raises(InvalidRecords, match="metrics.tsv is not what"):
        baseline.verified_files(path)
    (path / "metrics.tsv").unlink()
    with pytest.raises(InvalidRecords, match="lacks"):
        baseline.capture(path, tmp_path / "store")
    (path / "metrics.tsv").symlink_to(saved / "metrics.tsv")
    with pytest.raises(InvalidRecords, match="link"):
        baseline.verified_files(path)
    (path / "metrics.tsv").unlink()
    (path / "metrics.tsv").write_bytes(text)
    assert set(baseline.verified_files(path)) == set(tomllib.loads((path / "config.toml").read_text())["files"])
    (path / "more.txt").write_text("x")
    with pytest.raises(InvalidRecords, match="does not name"):
        baseline.verified_files(path)
    assert [p.name for p in tmp_path.iterdir()] == ["copy"]


def test_replay_to_the_last_byte(spark, groups, saved, tmp_path):
    assert baseline.require_same_experiment(groups, saved)["seeds"] == [0, 1]
    path = copy(saved, tmp_path)
    forged = (path / "paired.tsv").read_bytes() + b"\n"
    (path / "paired.tsv").write_bytes(forged)
    config = (path / "config.toml").read_text()
    (path / "config.toml").write_text(config.replace(baseline.file_sha256(saved / "paired.tsv"), baseline.file_sha256(path / "paired.tsv")))
    copied = lambda to, _: shutil.copytree(saved, to)
    with pytest.raises(InvalidRecords, match="paired.tsv differs"):  # although its own hashes fit
        baseline.require_replay(path, copied)
    (path / "config.toml").write_text(config.replace("budgets = [2, 5]", "budgets = [2, 6]"))
    (path / "paired.tsv").write_bytes((saved / "paired.tsv").read_bytes())
    with pytest.raises(InvalidRecords, match="budgets"):
        baseline.require_replay(path, copied)
    baseline.require_replay(path, copied, volatile=["budgets"])
    assert [p.name for p in tmp_path.iterdir()] == ["copy"]


def test_second_derivation_finds_one_changed_byte_in_each_kind(spark, saved, tmp_path):
    assert recheck.recheck(spark, saved) == len(recheck.CHECKS)
    path = copy(saved, tmp_path)
    for name, column, row in (("ranking", "composition", 3), ("metrics", "random_expected_hits_denominator", 1), ("method_summary", "mean_heldout_recall", 1), ("population", "unlabelled_count", 2), ("paired", "difference", 1), ("paired_summary", "zero", 3)):
        file = path / f"{name}.tsv"
        text = file.read_text()
        lines = [x.split("\t") for x in text.splitlines()]
        at = lines[0].index(column)
        cell = lines[row][at]
        last = cell[-1]
        lines[row][at] = cell[:-1] + (("1" if last != "1" else "2") if last.isdigit() else "x" if last != "x" else "y") if not cell.endswith(".0") else cell[:-1] + "7"
        file.write_text("".join("\t".join(x) + "\n" for x in lines))
        with pytest.raises(InvalidRecords, match=name):
            recheck.recheck(spark, path)
        file.write_text(text)


def test_evaluation_of_saved_rankings(spark, groups, tmp_path):
    split = splits.composition_splits(groups, [0, 1, 12], ("original",))
    ranking = experiments.rank_all(split, ("random", "similarity"))
    experiments.write_rankings(ranking, tmp_path)
    assert {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.tsv")} == {f"split-{s:02d}/{m}.tsv" for s in (0, 1, 12) for m in ("random", "similarity")}
    back = experiments.read_rankings(spark, str(tmp_path))
    columns = ["seed", "method", "rank", "composition", "score", "random_key", "tie_key", "observed_label"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, ranking.select(columns).collect()))
    again, saved = (experiments.evaluation_only(groups, [0, 1, 12], [2, 5], ("random", "similarity"), rankings) for rankings in (None, back))
    for name in ("metrics", "depths", "depth_summary"):
        assert sorted(map(str, again[name].select(sorted(again[name].columns)).collect())) == sorted(map(str, saved[name].select(sorted(again[name].columns)).collect()))
    depth = {(r["policy"], r["seed"], r["method"], r["budget"]): r["original_depth"] for r in saved["depths"].collect()}
    assert all(d == b if p == "original" else d >= b for (p, _, _, b), d in depth.items())
    (tmp_path / "split-00/random.tsv").write_text("rank\tcomposition\n")
    with pytest.raises(Exception, match="(?i)header|column|malformed"):
        experiments.read_rankings(spark, str(tmp_path)).collect()
