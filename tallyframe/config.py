"""Rules of a comparison and of a reconciliation. Plain values, checked when an operator takes them."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class NumericRule:
    tolerance: Decimal = Decimal(0)
    grouped: bool = False

    def __post_init__(self):
        if self.tolerance < 0:
            raise ValueError("a tolerance must not be negative")


@dataclass(frozen=True)
class CompareRules:
    """key: key columns. numeric wins over case_insensitive; ignored columns are neither compared nor validated."""

    key: tuple[str, ...]
    trim_keys: bool = True
    fold_keys: bool = False
    trim_values: bool = False
    case_insensitive: tuple[str, ...] = ()
    numeric: dict[str, NumericRule] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()

    def check(self, old: list[str], new: list[str]) -> None:
        if not self.key:
            raise ValueError("at least one key column is needed")
        for c in self.key:
            if c not in old or c not in new:
                raise ValueError(f"key column {c!r} is missing on a side")


@dataclass(frozen=True)
class MatchingRules:
    """A books day may lie `days_after` before the bank day up to `days_before` after it, ends included."""

    days_before: int = 3
    days_after: int = 3
    share_references: bool = False
    fold_references: bool = False


@dataclass(frozen=True)
class SideMapping:
    """Columns of one side. Either `amount` (with positive_is) or `money_in` and `money_out`."""

    date: str
    date_format: str
    amount: str | None = None
    positive_is: str = "in"
    money_in: str | None = None
    money_out: str | None = None
    unused: str = "blank"  # or "blank-or-zero"
    grouped: bool = False
    trailing_minus: bool = False
    parentheses: bool = False
    reference: str | None = None
    description: str | None = None
    batch: str | None = None

    def check(self, columns: list[str], minor_units: int) -> None:
        if not 0 <= minor_units <= 4:
            raise ValueError("minor units must be from 0 to 4")
        if (self.amount is None) == (self.money_in is None):
            raise ValueError("map either one amount column or money-in and money-out columns")
        if self.money_in is not None and self.money_in == self.money_out:
            raise ValueError("money in and money out must be different columns")
        for c in (self.date, self.amount, self.money_in, self.money_out, self.reference, self.description, self.batch):
            if c is not None and c not in columns:
                raise ValueError(f"mapped column {c!r} is missing")
