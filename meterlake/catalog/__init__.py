"""Registered queries over the shared test tables."""


def load():
    """(queries, SQL) by name."""
    from . import modelling, reports, tables  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
