"""Filters on a spectrum's number and place, taken over by the readers so that they open only the bytes they need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

#: Comparisons as (lowest, highest) of whole numbers.
_RANGES = {
    EqualTo: lambda v: (v, v), EqualNullSafe: lambda v: (v, v),
    GreaterThan: lambda v: (v + 1, None), GreaterThanOrEqual: lambda v: (v, None), LessThan: lambda v: (None, v - 1), LessThanOrEqual: lambda v: (None, v),
}


class Bounds:
    """What pushed filters leave of each column: a range, and a set of values where one was named."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.among: dict[str, frozenset] = {}
        self.columns = columns

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Notes what it understands and returns every filter: Spark applies them all again to the rows."""
        for f in filters:
            path = getattr(f, "attribute", ())
            name = path[0] if len(path) == 1 and path[0] in self.columns else None
            if name and isinstance(f, In):
                values = frozenset(v for v in f.value if v is not None)
                self.among[name] = self.among.get(name, values) & values
            elif name and type(f) in _RANGES and isinstance(f.value, int):
                low, high = _RANGES[type(f)](f.value)
                if low is not None:
                    self.low[name] = max(low, self.low.get(name, low))
                if high is not None:
                    self.high[name] = min(high, self.high.get(name, high))
            yield f

    def allow(self, **values: int) -> bool:
        return all(self.low.get(c, v) <= v <= self.high.get(c, v) and (c not in self.among or v in self.among[c]) for c, v in values.items())

    def __bool__(self) -> bool:
        return bool(self.low or self.high or self.among)
