"""All registered queries; importing this module fills the registry."""

from rollcall.plans import deduplication, flowing, keeping, normalising, proving, reporting, resolving, searching  # noqa: F401
from rollcall.plans.registry import ORACLES, QUERIES  # noqa: F401
