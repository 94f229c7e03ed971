"""The registered queries of the engine itself."""

from lakeloom.plans import algebra, functions, logs, more, relational, streams

MODULES = [relational, functions, logs, algebra, streams, more]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.R.functions.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.R.sql.items()}
