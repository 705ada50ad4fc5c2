"""The named queries: each a plan over the tables of a folder, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue(dict[str, tuple[Query, str | None]]):
    """name -> (query, SQL or None where SQL can't say it)."""

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self[query.__name__] = (query, sql)
            return query

        return put


def everything() -> Catalogue:
    from almanac.plans import corpus, entities, movement, readers, search, streams

    found = Catalogue()
    for module in (search, corpus, entities, streams, movement, readers):
        found |= module.CATALOGUE
    return found
