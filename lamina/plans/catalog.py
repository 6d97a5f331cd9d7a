"""A list of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from lamina.sources.views import oracle


class Catalog:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, views: str | None = None, sql: str | None = None):
        """Registers a function (spark, folder) -> DataFrame under its name, with an oracle over the named views."""

        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = oracle(views or "", sql)
            return f

        return register
