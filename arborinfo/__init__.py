"""Information trees over multivariate state data, expressed as Spark DataFrames."""

from arborinfo.plans.tree import InformationTree

__all__ = ["InformationTree"]
