"""Analysis of large collections of log lines with Spark DataFrames."""

from timberline.operators.filters import LogFilter, TimeRange
from timberline.operators.structuring import BRACKET_PRESET, Strategy
from timberline.plans.analysis import Analysis, AnalysisRequest, analyze

__all__ = ["Analysis", "AnalysisRequest", "BRACKET_PRESET", "LogFilter", "Strategy", "TimeRange", "analyze"]
