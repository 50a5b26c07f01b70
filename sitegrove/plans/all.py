"""Import every query module so the registry is complete."""

from . import q_assemble, q_catalog, q_changes, q_events, q_schedule, q_store, q_text  # noqa: F401
from .registry import REGISTRY  # noqa: F401
