"""All registered queries."""

from barframe.plans import base_sql  # noqa: F401
from barframe.plans import bars_q, log_q, mining_q, portfolio_q, series_q, sources_q, stream_q, trades_q, validate_q  # noqa: F401
from barframe.plans.portfolio_q import flagship  # noqa: F401
from barframe.plans.registry import ORACLE, QUERIES  # noqa: F401
