"""All registered queries."""

from carelake.registry import functions, loads, reports, views  # noqa: F401
from carelake.registry.base import ORACLES, QUERIES  # noqa: F401
