"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from lodestream.plans import aggregates, blocks, evaluation, extras, features, flagship, general, joins, more, stores, streams, supply, wider, windows

MODULES = [flagship, general, aggregates, windows, joins, features, blocks, evaluation, stores, streams, extras, more, supply, wider]
FLAGSHIP = flagship.ref_flagship


def _of(module) -> tuple[dict, dict]:
    return (module.query.queries, module.query.sql) if hasattr(module, "query") else (module.QUERIES, module.SQL)


def queries() -> dict:
    """All queries of the core."""
    return {k: v for m in MODULES for k, v in _of(m)[0].items()}


def oracle_sql() -> dict:
    """The SQL of those that have one."""
    return {k: v for m in MODULES for k, v in _of(m)[1].items()}
