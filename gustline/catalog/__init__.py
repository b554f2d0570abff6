"""Named queries over the driver's tables, one per operator, with equivalent SQL where there is one."""

from . import cleaning, forecasting, spatial, streams, timeseries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
