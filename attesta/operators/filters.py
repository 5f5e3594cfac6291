"""A declarative catalogue of filters, sorts and presets: parameters in, conditions on columns out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Filter = Callable[[str], Column | None]


def number(make: Callable[[float], Column]) -> Filter:
    """A filter of one number; what isn't one is ignored."""

    def apply(raw: str) -> Column | None:
        try:
            return make(float(raw))
        except ValueError:
            return None

    return apply


def choice(options: Mapping[str, Column]) -> Filter:
    """A filter of a fixed set; unknown choices are ignored."""
    return lambda raw: options.get(raw)


def contains(column: str) -> Filter:
    """Substring without regard to case; the value is literal, with no wildcards."""
    return lambda raw: F.contains(F.lower(F.col(column)), F.lower(F.lit(raw))) if raw.strip() else None


def build(catalogue: Mapping[str, Filter], params: Mapping[str, str]) -> tuple[Column, list[str]]:
    """(all active filters combined, their names); unknown names, blanks and bad values are ignored."""
    active = [(k, c) for k, f in catalogue.items() if params.get(k) and (c := f(params[k])) is not None]
    return reduce(lambda a, b: a & b, (c for _, c in active), F.lit(True)), [k for k, _ in active]


def order(sorts: Mapping[str, list], name: str, default: str) -> list:
    """The columns of a known sort, else of the default."""
    return sorts.get(name, sorts[default])
