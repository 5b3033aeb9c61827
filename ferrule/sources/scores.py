"""A Spark data source for score tables in SQLite files: standard and one-table-an-arity layouts."""

from __future__ import annotations

import json
import math
import operator
import sqlite3
from collections.abc import Sequence
from contextlib import closing, contextmanager
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..operators.query import QueryFilters

MAGIC = b"SQLite format 3\x00"
#: Tables of the one-table-an-arity layout: fixed values.
LEGACY = {"data2": 2, "data3": 3, "data4ionic": 4, "data5ionic": 5}
STANDARD_SCHEMA = "composition string, score double"
LEGACY_SCHEMA = "composition string, score double, nary int, elements array<string>, amounts array<bigint>"
ARROW = pa.schema([("composition", pa.string()), ("score", pa.float64()), ("nary", pa.int32()), ("elements", pa.list_(pa.string())), ("amounts", pa.list_(pa.int64()))])
#: Rows of an Arrow batch.
BATCH = 8192
#: Comparisons that Spark may leave to the scan, by their SQL and as done for a table's arity.
COMPARED = {
    ds.EqualTo: ("=", operator.eq), ds.GreaterThan: (">", operator.gt), ds.GreaterThanOrEqual: (">=", operator.ge), ds.LessThan: ("<", operator.lt), ds.LessThanOrEqual: ("<=", operator.le),
}
#: What SQLite must hold for a value to be one: anything else reads as null.
KINDS = {"score": "typeof(score) IN ('real', 'integer')", "composition": "typeof(composition) = 'text'"}


@contextmanager
def opened(path: str):
    """A read-only connection; what SQLite finds wrong with the file is a ValueError."""
    file = Path(path)
    if not file.is_file():
        raise ValueError(f"not a regular file: {path}")
    with file.open("rb") as f:
        if f.read(16) != MAGIC:
            raise ValueError(f"not a SQLite file: {path}")
    try:
        with closing(sqlite3.connect(f"file:{quote(str(file.resolve()))}?mode=ro", uri=True)) as connection:
            yield connection
    except sqlite3.Error as error:
        raise ValueError(f"{path}: {error}") from error


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(connection: sqlite3.Connection) -> list[tuple[str, int | None]]:
    """(name, arity) of the score tables: one standard table, or arity tables with their columns. Anything else is ambiguous."""
    names = [r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
    legacy, standard = [], []
    for name in names:
        columns = {r[1].lower() for r in connection.execute(f"PRAGMA table_info({quoted(name)})")}
        if not {"composition", "score"} <= columns:
            continue
        nary = LEGACY.get(name.lower())
        if nary and not {f"{c}{i}" for c in ("ele", "int") for i in range(1, nary + 1)} <= columns:
            raise ValueError(f"{name} lacks its element columns")
        (legacy if nary else standard).append((name, nary))
    if len(standard) > 1 or (legacy and standard):
        raise ValueError(f"several score tables: {', '.join(n for n, _ in legacy + standard)}")
    if not legacy + standard:
        raise ValueError("no score table")
    return legacy or standard


def database_info(path: str) -> dict:
    """Layout and tables (name, arity, ionic only) without reading a row."""
    with opened(path) as connection:
        found = tables(connection)
    return {"schema": "legacy" if found[0][1] else "standard", "tables": [(n, a, n.lower().endswith("ionic")) for n, a in found]}


def quick_check(path: str) -> None:
    """Ask SQLite whether the file is sound."""
    with opened(path) as connection:
        found = connection.execute("PRAGMA quick_check").fetchone()[0]
    if found != "ok":
        raise ValueError(f"{path}: {found}")


@dataclass
class TablePartition(ds.InputPartition):
    name: str
    nary: int | None
    low: int | None  # None: the whole table, which has no rowid
    high: int | None


@dataclass(frozen=True)
class Pushed:
    """What a scan leaves to SQLite. Scores that are null or no number always pass, so that a strict query meets them."""

    threshold: float | None = None
    inclusive: bool = True
    nary: tuple[int, ...] | None = None
    elements: tuple[str, ...] = ()

    @classmethod
    def read(cls, options) -> Pushed:
        """From the data source's options, whose names ignore case."""
        given = json.loads(options.get("pushed", "{}"))
        nary = given.get("nary")
        return cls(given.get("threshold"), given.get("inclusive", True), None if nary is None else tuple(nary), tuple(given.get("elements", ())))

    def where(self, nary: int | None) -> tuple[str, list]:
        parts, values = [], []
        if self.threshold is not None:
            parts.append(f"(score {'>=' if self.inclusive else '>'} ? OR score IS NULL)")  # text sorts after all numbers
            values.append(self.threshold)
        for element in self.elements if nary else ():
            parts.append(f"? IN ({', '.join(f'ele{i}' for i in range(1, nary + 1))})")
            values.append(element)
        return " AND ".join(parts), values


@dataclass(frozen=True)
class Where:
    """A filter of Spark's: SQL with its values for a column that SQLite has, or a test of a table's arity."""

    sql: str = ""
    values: tuple = ()
    arity: object = None

    @classmethod
    def of(cls, given: ds.Filter) -> Where | None:
        """None for what must stay with Spark."""
        if isinstance(given, ds.Not):
            return None
        column = given.attribute[0] if len(given.attribute) == 1 else None
        if isinstance(given, (ds.IsNotNull, ds.IsNull)) and column in KINDS:
            return cls(KINDS[column] if isinstance(given, ds.IsNotNull) else f"NOT ({KINDS[column]})")
        values = given.value if isinstance(given, ds.In) else (given.value,) if type(given) in COMPARED else None
        if values is None or any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values):
            return None
        if column == "nary":
            compare = COMPARED[type(given)][1] if type(given) in COMPARED else None
            return cls(arity=(compare, tuple(values)))
        if column not in KINDS or (column == "composition" and not isinstance(given, (ds.EqualTo, ds.In))):
            return None
        sign = f"IN ({', '.join('?' * len(values))})" if isinstance(given, ds.In) else f"{COMPARED[type(given)][0]} ?"
        collated = " COLLATE BINARY" if column == "composition" else ""
        return cls(f"{KINDS[column]} AND {column}{collated} {sign}", tuple(values))

    def fits(self, nary: int | None) -> bool:
        if self.arity is None or nary is None:
            return True
        compare, values = self.arity
        return nary in values if compare is None else compare(nary, values[0])


class ScoreReader(ds.DataSourceReader):
    """``allowed`` are the comparisons (column, sign, value) that every plan over this relation has.

    Spark 4.1 keeps what one plan has pushed for the relation's next plan, and for its other uses in the same plan, so
    a filter that only some of them have would take rows from the others. Whatever is not allowed stays with Spark.
    """

    def __init__(self, path: str, rows: int, pushed: Pushed, allowed: list | None = None):
        self.path, self.rows, self.pushed = path, rows, pushed
        self.allowed = [(c, sign, tuple(v) if sign == "in" else v) for c, sign, v in allowed or ()]
        self.where: list[Where] = []

    def _may(self, given: ds.Filter) -> bool:
        column = ".".join(getattr(given, "attribute", ()))
        if isinstance(given, ds.IsNotNull):
            return any(column == c for c, _, _ in self.allowed)
        sign = "in" if isinstance(given, ds.In) else COMPARED[type(given)][0] if type(given) in COMPARED else None
        return sign is not None and (column, sign, tuple(given.value) if sign == "in" else given.value) in self.allowed

    def pushFilters(self, filters):  # noqa: N802
        """Comparisons of score, of a whole composition and of the tables' arity are answered by SQLite; Spark keeps the rest."""
        for given in filters:
            if self._may(given) and (found := Where.of(given)):
                self.where.append(found)
            else:
                yield given

    def partitions(self):
        with opened(self.path) as connection:
            found, out = tables(connection), []
            for name, nary in found:
                if nary and (self.pushed.nary is not None and nary not in self.pushed.nary or not all(w.fits(nary) for w in self.where)):
                    continue
                try:
                    low, high = connection.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(name)}").fetchone()
                except sqlite3.OperationalError:  # a table WITHOUT ROWID
                    out.append(TablePartition(name, nary, None, None))
                    continue
                if low is not None:
                    out += [TablePartition(name, nary, at, at + self.rows) for at in range(low, high + 1, self.rows)]
            return out or [TablePartition(*found[0], 0, 0)]

    def statement(self, partition: TablePartition) -> tuple[str, list]:
        nary = partition.nary
        columns = ["composition", "score", *[f"{c}{i}" for c in ("ele", "int") for i in range(1, (nary or 0) + 1)]]
        where, values = self.pushed.where(nary)
        parts, bound = ([], []) if partition.low is None else (["rowid >= ?", "rowid < ?"], [partition.low, partition.high])
        parts += [where] * bool(where) + [f"({w.sql})" for w in self.where if w.sql]
        bound += [*values, *[v for w in self.where for v in w.values]]
        return f"SELECT {', '.join(columns)} FROM {quoted(partition.name)}" + (f" WHERE {' AND '.join(parts)}" if parts else ""), bound

    def read(self, partition):
        nary, schema = partition.nary, ARROW if partition.nary else pa.schema(list(ARROW)[:2])
        texts = lambda column: [x if isinstance(x, str) else None for x in column]
        numbers = lambda column: [x if isinstance(x, int) else None for x in column]
        with opened(self.path) as connection:
            rows = connection.execute(*self.statement(partition))
            while some := rows.fetchmany(BATCH):
                columns = list(zip(*some, strict=True))
                arrays = [texts(columns[0]), [float(x) if isinstance(x, (int, float)) else None for x in columns[1]]]
                if nary:
                    lists = (zip(*map(texts, columns[2 : 2 + nary]), strict=True), zip(*map(numbers, columns[2 + nary :]), strict=True))
                    arrays += [[nary] * len(some), *[[list(x) for x in each] for each in lists]]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema)


class ScoreSource(ds.DataSource):
    """format("sqlite_scores"), option path: rows are read in rowid ranges, so a large table is many tasks. The file must be on a path that executors share."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_scores"

    def schema(self) -> str:
        return LEGACY_SCHEMA if database_info(self.options["path"])["schema"] == "legacy" else STANDARD_SCHEMA

    def reader(self, schema) -> ScoreReader:
        return ScoreReader(self.options["path"], int(self.options.get("rows", "200000")), Pushed.read(self.options), json.loads(self.options.get("where", "[]")))


def register(spark: SparkSession) -> None:
    """Make format("sqlite_scores") known, and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScoreSource)


def compared(column: str, sign: str, value) -> Column:
    """The condition of one comparison; signs are =, >, >=, <, <= and in."""
    signs = {name: does for name, does in COMPARED.values()}
    if sign != "in" and sign not in signs:
        raise ValueError(f"{sign} is no comparison")
    return F.col(column).isin(*value) if sign == "in" else signs[sign](F.col(column), F.lit(value))


def read_scores(spark: SparkSession, path: str, filters: QueryFilters | None = None, where: Sequence[tuple] = ()) -> DataFrame:
    """The file's score table, in Arrow batches.

    ``where`` holds comparisons (column, sign, value) of score, composition and nary: rows that meet them all are
    returned, and Spark leaves the work to SQLite. Given filters keep rows without a score, which a strict query must
    meet: threshold goes to rows, arity to tables, elements to element columns; the query's own filters still apply, as
    a standard table has no arity or elements to filter by.
    """
    register(spark)
    pushed = "{}" if filters is None else json.dumps({"threshold": filters.threshold, "inclusive": filters.inclusive, "nary": filters.nary, "elements": filters.elements})
    exact = [(c, sign, list(v) if sign == "in" else v) for c, sign, v in where]
    exact = [(c, sign, (list(map(float, v)) if sign == "in" else float(v)) if c == "score" else v) for c, sign, v in exact]
    rows = spark.read.format("sqlite_scores").option("path", path).option("pushed", pushed).option("where", json.dumps(exact)).load()
    for comparison in exact:
        rows = rows.where(compared(*comparison))
    return rows
