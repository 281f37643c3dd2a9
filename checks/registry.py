"""Registration of queries: name, output shape, Spark function, and the SQL that checks it (if there is one)."""

from __future__ import annotations

from .shape import shaped
from .sql import finish

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, spec: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: shaped(build(spark, sf_dir), spec)
        if sql is not None:
            SQL[name] = finish(sql, spec)
        return build
    return register
