"""Contracts of nested rows: a declared shape becomes one column that names every place where a row departs from it.

A contract is checked inside the JVM where the row lies. Faults are texts of a path and a message, with the places of
arrays in brackets: ``owners[3].range.hi: must be 0 or more``. A row without faults has an empty array.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shape(ABC):
    """What a value must be. A value that may be missing has no fault if it is."""

    may_miss = False

    @abstractmethod
    def within(self, value: Column, path: Column) -> Column:
        """The faults of a value that is there."""

    def faults(self, value: Column, path: Column) -> Column:
        missing = F.array().cast("array<string>") if self.may_miss else F.array(_said(path, "is missing"))
        return F.when(value.isNull(), missing).otherwise(self.within(value, path))


def _said(path: Column, message: str) -> Column:
    return F.concat(path, F.lit(f": {message}"))


def _broken(path: Column, *rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), _said(path, message)) for ok, message in rules]))


@dataclass
class Maybe(Shape):
    """A value that may be missing."""

    of: Shape
    may_miss = True

    def within(self, value: Column, path: Column) -> Column:
        return self.of.within(value, path)


@dataclass
class Text(Shape):
    least: int = 1
    pattern: str | None = None
    named: str = "must have the right form"

    def within(self, value: Column, path: Column) -> Column:
        rules = [(F.length(value) >= self.least, f"must have {self.least} letters or more")]
        return _broken(path, *rules, *([(value.rlike(self.pattern), self.named)] if self.pattern else []))


@dataclass
class OneOf(Shape):
    values: tuple[str | int, ...]

    def within(self, value: Column, path: Column) -> Column:
        return _broken(path, (value.isin(*self.values), "must be one of " + ", ".join(map(str, self.values))))


@dataclass
class Number(Shape):
    least: float | None = 0
    most: float | None = None

    def within(self, value: Column, path: Column) -> Column:
        rules = [(value >= self.least, f"must be {self.least} or more")] if self.least is not None else []
        return _broken(path, *rules, *([(value <= self.most, f"must be {self.most} or less")] if self.most is not None else []))


@dataclass
class Any(Shape):
    """There, whatever it is: its type is the column's."""

    def within(self, value: Column, path: Column) -> Column:
        return F.array().cast("array<string>")


@dataclass
class Many(Shape):
    of: Shape
    least: int = 0
    most: int | None = None

    def within(self, value: Column, path: Column) -> Column:
        rules = [(F.size(value) >= self.least, f"must have {self.least} or more")] if self.least else []
        rules += [(F.size(value) <= self.most, f"must have {self.most} or fewer")] if self.most is not None else []
        inside = F.flatten(F.transform(value, lambda v, i: self.of.faults(v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.concat(_broken(path, *rules), inside)


@dataclass
class Fields(Shape):
    """A struct's fields, and rules over several of them (a condition and a message)."""

    fields: dict[str, Shape]
    rules: list[tuple[Callable[[Column], Column], str]] = field(default_factory=list)

    def within(self, value: Column, path: Column) -> Column:
        each = [shape.faults(value[name], F.concat(path, F.lit(f".{name}"))) for name, shape in self.fields.items()]
        # A rule over fields of which one is missing says nothing: that one has a fault of its own.
        own = [F.when(~rule(value), _said(path, message)) for rule, message in self.rules]
        return F.concat(*each, F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"))


def faults(shape: Fields, row: Column | None = None, name: str | None = None) -> Column:
    """The faults of a struct column, or of a whole row (its columns by their names). ``name`` stands before the path."""
    get = (lambda n: row[n]) if row is not None else F.col
    lead = F.lit(f"{name}." if name else "")
    each = [s.faults(get(n), F.concat(lead, F.lit(n))) for n, s in shape.fields.items()]
    own = [F.when(~rule(row if row is not None else _Row()), F.lit(f"{name or 'row'}: {message}")) for rule, message in shape.rules]
    return F.concat(*each, F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"))


class _Row:
    """The columns of a row, as a struct has its fields."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def checked(rows: DataFrame, shape: Fields) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and the others with ``faults``."""
    told = rows.withColumn("faults", faults(shape))
    return told.where(F.size("faults") == 0).drop("faults"), told.where(F.size("faults") > 0)


#: Fixed values of the disclosed rows.
PARTIES, CHAMBERS, STATUSES, OWNERS, SIDES = ("R", "D", "I"), ("house", "senate"), ("holds", "sold", "stale"), ("self", "spouse", "dependent", "joint", "trust"), ("buy", "sell")
MEMBER_ID = Text(pattern=r"^[A-Z]\d{6}$", named="must be a letter and six digits")
RANGE = Fields({"lo": Number(), "hi": Number()}, [(lambda r: r["hi"] >= r["lo"], "hi must not be below lo")])
#: An entry of the directory of members with trades.
DIRECTORY = Fields({
    "member": MEMBER_ID, "name": Text(), "party": OneOf(PARTIES), "chamber": OneOf(CHAMBERS), "state": Text(pattern=r"^..$", named="must have two letters"), "active": Any(), "trades": Number(), "last_trade": Any(), "on_roster": Any(),
})
#: A security that several members hold, with all of its owners.
COMMON = Fields(
    {
        "security": Text(), "owners_count": Number(2), "party_r": Number(), "party_d": Number(), "party_i": Number(), "latest_buy": Maybe(Any()),
        "owners": Many(Fields({"member": MEMBER_ID, "name": Text(), "party": OneOf(PARTIES), "status": OneOf(STATUSES), "range": RANGE, "buy_dates": Many(Any(), most=10)}), least=2),
    },
    [
        (lambda r: r["party_r"] + r["party_d"] + r["party_i"] == r["owners_count"], "the parties must sum to owners_count"),
        (lambda r: F.size(F.filter(r["owners"], lambda o: o["status"] != "sold")) == r["owners_count"], "owners_count must be the number of owners that have not sold"),
    ],
)
#: The document of one member.
PORTFOLIO = Fields({
    "member": MEMBER_ID, "name": Text(), "positions": Many(Fields({"security": Text(), "owner": OneOf(OWNERS), "status": OneOf(STATUSES), "range": RANGE, "as_of": Any()})),
    "trades": Many(Fields({"asset": Text(), "security": Maybe(Text()), "side": OneOf(SIDES), "owner": Maybe(OneOf(OWNERS)), "range": RANGE, "traded": Any(), "filed": Any()}, [(lambda t: t["filed"] >= t["traded"], "filed before it was traded")]), least=1),
    "series": Many(Fields({"date": Any(), "value": Number()})),
})
