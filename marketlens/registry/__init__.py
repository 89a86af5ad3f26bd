"""Named queries over the driver's tables and the SQL they are compared with."""

from marketlens.registry import cleaning, measures, scalars, reports, texts  # noqa: F401
from marketlens.registry.base import ORACLES, QUERIES  # noqa: F401
