"""The registered queries: each operator applied to the driver's tables.

A catalog module fills :data:`CATALOG` through :func:`query`; the entry point
turns it into ``queries()`` and ``oracle_sql()``.
"""

from importlib import import_module

MODULES = ("signals", "events", "repeats", "tracks", "files", "studies", "fits", "reports")


def load() -> None:
    """Import every catalog module once, which registers its queries."""
    for name in MODULES:
        import_module(f"kinetrail.catalog.{name}")
