"""The catalogue of queries: each Spark plan beside the SQL that must give the same rows."""


def catalogue():
    """({name: query}, {name: SQL}) over every module of this package."""
    from importlib import import_module
    from pkgutil import iter_modules

    from .registry import ORACLES, QUERIES

    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
    return dict(QUERIES), dict(ORACLES)
