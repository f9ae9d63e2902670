"""Connected components, as the graph operators find them."""

from ..operators.graph import components

__all__ = ["components"]
