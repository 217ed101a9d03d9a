"""Fixture views and registered queries."""

from .registry import REGISTRY  # noqa: F401
from . import q_frames  # noqa: F401  (registers queries)
from . import q_stats  # noqa: F401,E402
from . import q_valid  # noqa: F401,E402
from . import q_models  # noqa: F401,E402
