"""Connected components for the corpus operators: the library's general helper."""

from ..operators.graph import connected_components as components  # noqa: F401
