"""Connected components of a link table: the library's own."""

from scene_analytics.operators.components import connected_components

__all__ = ["connected_components"]
