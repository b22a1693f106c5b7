"""Queries over the driver tables and their oracles."""


def load_cases():
    """(queries, oracles) of every case module."""
    import importlib
    import pkgutil

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_cases")):
        importlib.import_module(f"checks.{module}")
    from checks.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
