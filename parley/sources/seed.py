"""Reseeding: tables are cleared with all that depends on them, and filled again from id 1 in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.numbering import dense_number
from parley.operators.relational import lookup
from parley.schema import FOREIGN_KEYS
from parley.sources.versions import TableSet

Keys = tuple[tuple[str, str, str], ...]


def dependants(cleared: set[str], keys: Keys = FOREIGN_KEYS) -> set[str]:
    """The tables themselves and all that refer to them, directly or not."""
    found = set(cleared)
    while more := {child for child, _, parent in keys if parent in found} - found:
        found |= more
    return found


def parents_first(names: set[str], keys: Keys = FOREIGN_KEYS) -> list[str]:
    """Names so that a table follows all tables that it refers to; a cycle is an error."""
    left, out = set(names), []
    while left:
        free = sorted(n for n in left if not any(c == n and p in left and p != n for c, _, p in keys))
        if not free:
            raise ValueError(f"tables refer to each other: {', '.join(sorted(left))}")
        out += free
        left -= set(free)
    return out


def cleared(tables: dict[str, DataFrame], names: set[str], keys: Keys = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """``tables`` with the named ones and their dependants empty; the others are as they were."""
    gone = dependants(names, keys)
    return {n: rows.limit(0) if n in gone else rows for n, rows in tables.items()}


def reseeded(tables: dict[str, DataFrame], seeds: dict[str, DataFrame], order: dict[str, list[str]], keys: Keys = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """``tables`` after the seeded ones and their dependants are cleared and the seeds are inserted.

    A seed has a column ``key`` (unique) in place of ``id``, and refers to its
    parents by their keys; a reference to a table that is not seeded is taken
    as an id. Ids are 1, 2, ... in the table's ``order`` (by key without one). A key that no parent has is an error.
    """
    out, ids = cleared(tables, set(seeds), keys), {}
    for name in parents_first(set(seeds), keys):
        rows = seeds[name]
        for child, column, parent in keys:
            if child == name and parent in seeds and column in rows.columns:
                known = ids[parent].select(F.col("key").alias(column), F.col("id").alias("_id"))
                rows = lookup(rows, known, column, "_id", required=True).drop(column).withColumnRenamed("_id", column)
        numbered = dense_number(rows, order.get(name, ["key"]))
        ids[name] = numbered.select("key", "id")
        kinds = dict(tables[name].dtypes)
        given = numbered.drop("key")
        out[name] = tables[name].limit(0).unionByName(given.select(*[given[c].cast(kinds.get(c, t)).alias(c) for c, t in given.dtypes]), allowMissingColumns=True)
    return out


def reseed(store: TableSet, seeds: dict[str, DataFrame], order: dict[str, list[str]] | None = None, keys: Keys = FOREIGN_KEYS) -> int:
    """Clear and fill the tables of a versioned set in one commit; repeated, it leaves the same rows. Returns the version."""
    base = store.version()
    now = store.read(version=base)
    changed = dependants(set(seeds), keys) & set(now)
    after = reseeded(now, seeds, order or {}, keys)
    return store.commit({n: after[n] for n in changed}, base=base)
