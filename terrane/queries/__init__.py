"""Registered queries of the core: callables over a table folder, and the SQL that an independent engine runs."""

from terrane.queries import code, events, graph, incremental, lifecycle, passthrough, search, text, tree

_MODULES = [incremental, tree, text, search, graph, events, passthrough, code, lifecycle]


def queries():
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
