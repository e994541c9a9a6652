"""Binned scatter plots on Spark DataFrames."""

from .plans.api import bin_plot

__all__ = ["bin_plot"]
