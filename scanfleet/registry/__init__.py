"""Named queries over the test tables, each with the DuckDB SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.testviews import Fixture, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views=(), sql: str | None = None):
    """Register ``fn(fixture) -> DataFrame`` under ``name``; ``sql`` is the oracle body over ``views``."""

    def wrap(fn):
        def run(spark, sf_dir):
            return fn(Fixture(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return wrap


def load_all() -> None:
    import importlib
    import pkgutil

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
