"""All registered queries; importing this package fills the registry."""

from solstice.plans.queries import calendar, catalog, crops, cube, gates, gazetteer, grid, rules, search, series, sources, spatial, text, tracks  # noqa: F401
from solstice.plans.registry import ORACLES, QUERIES  # noqa: F401
