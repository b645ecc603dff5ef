"""All registered queries and their oracles."""

from sheaf.plans import checks_fetch, checks_html, checks_intake, checks_logs, checks_more, checks_results  # noqa: F401
from sheaf.plans.check import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
