"""Named queries and their SQL counterparts, used by the driver contract."""

from importlib import import_module

_SECTIONS = (
    "laps", "cleaning", "sources", "files", "forecasts", "intervals", "statistics", "shapes", "decisions", "model", "streams", "telemetry", "fleet", "search",
)


def load():
    """Collect every section's queries and oracle SQL."""
    queries, oracles = {}, {}
    for name in _SECTIONS:
        section = import_module(f"wearframe.catalog.{name}")
        queries.update(section.QUERIES)
        oracles.update(section.ORACLES)
    return queries, oracles
