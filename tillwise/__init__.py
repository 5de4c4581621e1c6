"""Retail growth, retention and guest-order analytics as Spark DataFrame jobs."""

from tillwise.config import AnalysisConfig, CleaningRules, DayWindow, InsightMonths

__all__ = ["AnalysisConfig", "CleaningRules", "DayWindow", "InsightMonths"]
