"""Search, ranking and summaries over Spark DataFrames."""

from siftwell.roles import Roles

__all__ = ["Roles"]
