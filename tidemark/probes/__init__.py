"""One query for each operator over the driver's tables, with the same in SQL."""

from . import aggregates, decisions, flagship, joins, rows, scalars  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
