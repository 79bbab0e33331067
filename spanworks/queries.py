"""Named queries over the reference's operators, with their oracle SQL."""

from .plans import checks, contents, graphs, inventory, locate, ranking, retrieval, surface, workspace  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
