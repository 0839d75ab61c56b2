"""Named queries over the tables, and the SQL that says the same."""

from pantrygrid.plans import compare, journal, kitchen, menus, planner, rules, search

FLAGSHIP = "bm25_topk"
MODULES = (search, kitchen, journal, menus, rules, planner, compare)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
