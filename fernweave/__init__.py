"""A PySpark-native engine for code-and-document knowledge graphs."""

from fernweave.api import Workspace
from fernweave.graph import EDGE_WEIGHTS, Graph

__all__ = ["EDGE_WEIGHTS", "Graph", "Workspace"]
