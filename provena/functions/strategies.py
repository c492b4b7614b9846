"""Registry of strategies: named ways to compute one operator, compared like candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_known: dict[str, dict[str, Callable[..., DataFrame]]] = {}


def register(operator: str, strategy: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _known.setdefault(operator, {})[strategy] = f
        return f

    return add


def strategies(operator: str) -> dict[str, Callable[..., DataFrame]]:
    return dict(_known.get(operator, {}))


def run_all(operator: str, *args) -> dict[str, tuple[DataFrame | None, str | None]]:
    """Each strategy's result or its error: one failing candidate does not end the others."""
    out: dict[str, tuple[DataFrame | None, str | None]] = {}
    for name, f in strategies(operator).items():
        try:
            df = f(*args)
            df.schema  # analysis errors show here
            out[name] = (df, None)
        except Exception as e:  # a candidate's failure is its result
            out[name] = (None, str(e).splitlines()[0])
    return out
