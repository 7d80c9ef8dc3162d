"""Stand-in views over the driver tables, registered queries and their SQL."""

from importlib import import_module

MODULES = ("scalar_queries", "sales_queries", "publishing_queries", "planning_queries", "cycle_queries", "master_queries", "sink_queries", "file_queries", "commit_queries", "lock_queries", "review_queries", "detail_queries")


def load():
    """Query and SQL registries with every query module imported."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from stockweave.plans import registry

    return registry.QUERIES, registry.ORACLES
