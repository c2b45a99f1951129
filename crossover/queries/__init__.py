"""The registered queries, by area."""

from importlib import import_module

AREAS = ["validation", "inventory", "text", "scores", "mapping", "logs", "load", "sync"]


def _load():
    for area in AREAS:
        import_module(f"crossover.queries.{area}")
    from crossover.queries import registry
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
