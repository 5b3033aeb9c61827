"""Formulas as Column expressions: parse, validate, reduce, compare. Nothing here leaves the JVM."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from math import gcd as gcd_of
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elements import SYMBOLS, validate_element

TOKEN = "([A-Z][a-z]?)([0-9]*)"
SYNTAX = r"\A(?:[A-Z][a-z]?(?:[1-9][0-9]*)?)+\z"
TERMS = "array<struct<symbol:string,amount:bigint>>"
#: Euclid's steps that any pair of 64-bit integers needs.
EUCLID_STEPS = 93
#: Up to this least amount, trying divisors is quicker than Euclid's steps.
TRIED = 32
LARGEST = (1 << 63) - 1


def tokens(f: Column) -> Column:
    """Symbols and amounts as written; an amount beyond 64 bits is null."""
    amount = lambda d: F.when(d == "", F.lit(1).cast("long")).otherwise(d.try_cast("long"))
    return F.zip_with(
        F.regexp_extract_all(f, F.lit(TOKEN), F.lit(1)),
        F.regexp_extract_all(f, F.lit(TOKEN), F.lit(2)),
        lambda s, d: F.struct(s.alias("symbol"), amount(d).alias("amount")),
    )


def totals(written: Column) -> Column:
    """One term a symbol, sorted; a total beyond 64 bits is null."""
    symbols = F.array_sort(F.array_distinct(F.transform(written, lambda t: t["symbol"])))
    return F.transform(
        symbols,
        lambda s: F.struct(
            s.alias("symbol"),
            F.aggregate(F.filter(written, lambda t: t["symbol"] == s), F.lit(0).cast("long"), lambda n, t: F.try_add(n, t["amount"])).alias("amount"),
        ),
    )


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs."""
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(EUCLID_STEPS)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b"))),
    )
    return done["a"]


def reduced(terms: Column) -> Column:
    """Terms divided by the greatest common divisor of their amounts."""
    amounts = F.transform(terms, lambda t: t["amount"])
    least = F.array_min(amounts)
    small = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), least), lambda d: F.forall(amounts, lambda a: a % d == 0)))
    by = F.when(least == 1, F.lit(1).cast("long")).when(least <= TRIED, small).otherwise(F.aggregate(amounts, F.lit(0).cast("long"), gcd))
    return F.transform(terms, lambda t: F.struct(t["symbol"].alias("symbol"), F.call_function("div", t["amount"], by).alias("amount")))


def formula(terms: Column) -> Column:
    """Canonical text; null for null terms."""
    return F.array_join(F.transform(terms, lambda t: F.concat(t["symbol"], t["amount"].cast("string"))), "")


def species(terms: Column) -> Column:
    return F.transform(terms, lambda t: t["symbol"])


def system(terms: Column) -> Column:
    return F.array_join(species(terms), "-")


def norm(terms: Column) -> Column:
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda n, t: n + (t["amount"] * t["amount"]).cast("double")))


def dot(terms: Column, other: Column) -> Column:
    """Sum of products over the symbols of both."""
    return F.aggregate(
        terms,
        F.lit(0.0),
        lambda n, t: n + F.aggregate(F.filter(other, lambda u: u["symbol"] == t["symbol"]), F.lit(0.0), lambda m, u: m + (t["amount"] * u["amount"]).cast("double")),
    )


def cosine(terms: Column, other: Column, equal: Column | None = None) -> Column:
    """Cosine similarity in 0 to 1; ``equal`` short-cuts to exactly 1."""
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(terms, other) / (norm(terms) * norm(other))))
    return value if equal is None else F.when(equal, F.lit(1.0)).otherwise(value)


PARSED = ("formula_error", "terms", "formula", "species", "nary", "system")


def with_composition(df: DataFrame, column: str = "composition") -> DataFrame:
    """Adds formula_error, terms, formula, species, nary and system; all but the error are null where it is not.

    Errors in order: not text (invalid_record), bad syntax (unsupported_syntax), an amount that is too large
    (invalid_record), an unknown symbol (unsupported_symbol), a total that is too large (invalid_record).

    Each distinct text is parsed once and joined back: tables repeat their formulas many times over. Streams are
    parsed row by row.
    """
    if df.isStreaming:
        return parse_each(df, column)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not made smaller: texts are short, but slow to parse
    parsed = parse_each(df.select(F.col(column).alias("__text")).where("__text IS NOT NULL").distinct().repartition(tasks), "__text")
    joined = df.join(parsed, F.col(column) == F.col("__text"), "left").drop("__text")
    return joined.withColumn("formula_error", F.when(F.col(column).isNull(), "invalid_record").otherwise(F.col("formula_error")))


def parse_each(df: DataFrame, column: str = "composition") -> DataFrame:
    """with_composition row by row, for tables of distinct texts."""
    f = F.col(column)
    known = F.array(*[F.lit(s) for s in SYMBOLS])
    spelled = F.coalesce(f.rlike(SYNTAX), F.lit(False))
    step = _once(df, __spelled=spelled, __written=F.when(spelled, tokens(f)))
    step = _once(step, __totals=totals(F.col("__written")))
    bad = (
        F.when(f.isNull(), "invalid_record")
        .when(~F.col("__spelled"), "unsupported_syntax")
        .when(F.exists("__written", lambda t: t["amount"].isNull()), "invalid_record")
        .when(F.exists("__written", lambda t: ~F.array_contains(known, t["symbol"])), "unsupported_symbol")
        .when(F.exists("__totals", lambda t: t["amount"].isNull()), "invalid_record")
    )
    step = _once(step, formula_error=bad)
    step = _once(step, terms=F.when(F.col("formula_error").isNull(), reduced(F.col("__totals")))).drop("__spelled", "__written", "__totals")
    t = F.col("terms")
    return _once(step, formula=formula(t), species=species(t), nary=F.when(t.isNotNull(), F.size(t)), system=system(t))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as the one row of a generator, so that no filter or projection above repeats the work inside."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _amounts(source: str | Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """Symbol and amount of each part; what is no part of a formula raises."""
    if isinstance(source, Mapping):
        yield from source.items()
        return
    at = 0
    for part in re.finditer(r"([A-Z][a-z]?)([1-9][0-9]*)?", source):
        if part.start() != at:
            break
        at = part.end()
        yield part[1], int(part[2] or 1)
    if at != len(source):
        raise ValueError(f"{source!r} is no simple formula: at character {at + 1} there is no element with a whole amount")


class Composition:
    """A reduced composition on the driver, for arguments such as a reference formula."""

    def __init__(self, source: str | Mapping[str, int]):
        written: Counter[str] = Counter()
        for symbol, amount in _amounts(source):
            if type(amount) is not int or amount < 1:
                raise ValueError(f"{symbol} has amount {amount!r}, which is no whole number above 0")
            written[validate_element(symbol)] += amount
        if not written:
            raise ValueError("a composition has at least one element")
        if (most := max(written.values())) > LARGEST:
            raise ValueError(f"the amount {most} does not fit 64 bits")
        shared = gcd_of(*written.values())
        self.terms = tuple((symbol, n // shared) for symbol, n in sorted(written.items()))

    @property
    def formula(self) -> str:
        return "".join(f"{symbol}{n}" for symbol, n in self.terms)

    @property
    def species(self) -> tuple[str, ...]:
        return tuple(symbol for symbol, _ in self.terms)

    @property
    def norm(self) -> float:
        return sqrt(sum(n * n for _, n in self.terms))

    def __eq__(self, other) -> bool:
        return isinstance(other, Composition) and self.terms == other.terms

    def __hash__(self) -> int:
        return hash(self.terms)

    def __len__(self) -> int:
        return len(self.terms)

    def __repr__(self) -> str:
        return f"Composition({self.formula!r})"

    def similarity(self, other: Composition) -> float:
        if self == other:
            return 1.0
        mine = dict(self.terms)
        return min(1.0, max(0.0, sum(mine.get(s, 0) * n for s, n in other.terms) / (self.norm * other.norm)))

    def cosine(self, terms: Column, formula: Column) -> Column:
        """Cosine similarity of a column of terms to this composition; its own formula has exactly 1."""
        amounts = F.create_map(*[F.lit(x) for term in self.terms for x in term]).cast("map<string,bigint>")
        shared = F.aggregate(terms, F.lit(0.0), lambda n, t: n + (t["amount"] * F.coalesce(F.try_element_at(amounts, t["symbol"]), F.lit(0))).cast("double"))
        return F.when(formula == self.formula, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared / (norm(terms) * F.lit(self.norm)))))
