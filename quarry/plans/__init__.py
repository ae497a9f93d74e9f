"""Driver-facing queries over the test tables, with SQL twins."""

from quarry.plans import administration, crawl, derived, directory, ends, extraction, golden, publishing, relational, requests  # noqa: F401
from quarry.plans.registry import CASE_ROWS, CASES, ORACLES, QUERIES  # noqa: F401
