"""Registration of queries and the tables they read.

The given tables hold pages, documents and events, not API inventories, so
most queries run over tables that Spark derives from them: one derived row (or
more) per row of the given table, whatever its size.  A derivation is one SQL
text that Spark and the comparison engine both run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``sql`` may read the derived tables in ``uses``."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = with_inputs(uses, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a table derived from given ones."""
    if name not in inputs.DERIVED:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    needs, text = inputs.DERIVED[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs})


def with_inputs(uses: tuple[str, ...], sql: str) -> str:
    """The same derivations as a WITH list in front of ``sql``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in inputs.DERIVED:
            return
        needs, text = inputs.DERIVED[name]
        for n in needs:
            add(n)
        done[name] = text.format(**{n: n for n in needs})

    for name in uses:
        add(name)
    if not done:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{t}\n)" for n, t in done.items())
    return f"WITH {ctes}\n{sql}" if not sql.lstrip().upper().startswith("WITH ") else \
        f"WITH {ctes},\n{sql.lstrip()[5:]}"


def lit(text: str) -> str:
    """SQL string literal of a text or pattern.

    RE2 knows neither possessive marks nor look-behind: the marks are dropped,
    and "no name character before" becomes "start or another character".
    """
    for java, re2 in ((r"(?<![\w$])", r"(?:^|[^\w$])"), (r"(?<![\w.])", r"(?:^|[^\w.])"),
                      ("*+", "*")):
        text = text.replace(java, re2)
    return "'" + text.replace("'", "''") + "'"
