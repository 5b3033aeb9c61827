"""Saved runs as baselines: captured by content with safe names only, and replayed to the last byte."""

from __future__ import annotations

import filecmp
import hashlib
import os
import shutil
import tempfile
import tomllib
from collections.abc import Callable, Collection
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame

from ..operators.query import InvalidRecords
from ..sources.sinks import new_directory, write_toml

CONFIG, OBJECTS, INVENTORY = "config.toml", "objects", "inventory.toml"


def safe_path(root: Path, name: str) -> Path:
    """The file of that relative name, which must lie below the root and be no link, nor reached through one."""
    pure = PurePosixPath(name)
    if not name or "\\" in name or "\0" in name or pure.is_absolute() or ".." in pure.parts or pure.as_posix() != name:
        raise InvalidRecords(f"unsafe name in a baseline: {name!r}")
    at = root
    for part in pure.parts:
        at = at / part
        if at.is_symlink():
            raise InvalidRecords(f"link in a baseline: {name!r}")
    if not at.is_file():
        raise InvalidRecords(f"a baseline lacks {name!r}")
    return at


def file_sha256(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_config(path: str | Path) -> dict:
    config = tomllib.loads(safe_path(Path(path), CONFIG).read_text())
    if not isinstance(config.get("files"), dict) or not all(isinstance(v, str) for v in config["files"].values()):
        raise InvalidRecords("a baseline's config has no list of files and hashes")
    return config


def verified_files(path: str | Path) -> dict[str, Path]:
    """Every file that the config names, by name, with the hash that it has there; files that it does not name are refused."""
    root, config = Path(path), read_config(path)
    out = {}
    for name, digest in config["files"].items():
        out[name] = safe_path(root, name)
        if file_sha256(out[name]) != digest:
            raise InvalidRecords(f"{name} is not what the baseline's config says")
    besides = {p.relative_to(root).as_posix() for p in root.rglob("*") if not p.is_dir() or p.is_symlink()} - set(out) - {CONFIG}
    if besides:
        raise InvalidRecords(f"files that the baseline's config does not name: {sorted(besides)[:3]}")
    return out


def capture(path: str | Path, store: str | Path, keep: Callable[[str], bool] = lambda name: True) -> dict[str, str]:
    """Copy a verified baseline's config and wanted files into a new store, each once by its hash; returns the inventory."""
    files = verified_files(path)
    chosen = {CONFIG: Path(path) / CONFIG} | {n: p for n, p in files.items() if keep(n)}
    with new_directory(str(store)) as root:
        (root / OBJECTS).mkdir()
        inventory = {}
        for name, source in sorted(chosen.items()):
            making = root / OBJECTS / f".{os.getpid()}.part"
            shutil.copyfile(source, making)
            inventory[name] = file_sha256(making)  # of the copy: the source may have changed meanwhile
            if name != CONFIG and inventory[name] != read_config(path)["files"][name]:
                raise InvalidRecords(f"{name} changed while it was captured")
            making.rename(root / OBJECTS / inventory[name])
        write_toml({"files": inventory}, root / INVENTORY)
    return inventory


def captured(store: str | Path, name: str) -> Path:
    """The object that a store holds for a name, checked again."""
    inventory = tomllib.loads((Path(store) / INVENTORY).read_text())["files"]
    if name not in inventory:
        raise InvalidRecords(f"nothing was captured as {name!r}")
    found = safe_path(Path(store), f"{OBJECTS}/{inventory[name]}")
    if file_sha256(found) != inventory[name]:
        raise InvalidRecords(f"the object of {name!r} has another hash")
    return found


def require_replay(path: str | Path, make: Callable[[str, dict], None], volatile: Collection[str] = ()) -> dict:
    """Run a baseline anew with make(directory, its config), and compare all settings and every file byte for byte; returns the config.

    Top-level settings named in ``volatile`` may differ.
    """
    files, config = verified_files(path), read_config(path)
    with tempfile.TemporaryDirectory(dir=Path(path).absolute().parent, prefix=".replay-") as scratch:
        again = Path(scratch) / "again"
        make(str(again), config)
        other = read_config(again)
        for name in sorted({*config, *other} - {"files", *volatile}):
            if config.get(name) != other.get(name):
                raise InvalidRecords(f"a baseline's {name} is {config.get(name)!r}, and {other.get(name)!r} when run again")
        rebuilt = verified_files(again)
        if set(rebuilt) != set(files):
            raise InvalidRecords(f"run again, a baseline has other files: {sorted(set(rebuilt) ^ set(files))[:3]}")
        for name, file in files.items():
            if not filecmp.cmp(file, rebuilt[name], shallow=False):
                raise InvalidRecords(f"{name} differs from what the same run gives now")
    return config


def require_same_experiment(groups: DataFrame, path: str | Path) -> dict:
    """Replay an experiment that write_experiment saved with its settings, from the groups that it was made of."""
    from .experiments import experiment, write_experiment

    def make(directory: str, config: dict) -> None:
        tables = experiment(groups, config["designs"], config["policies"], config["seeds"], config["budgets"], config["methods"])
        write_experiment(tables, directory, {k: v for k, v in config.items() if k != "files"})

    return require_replay(path, make)
