"""Spectral graph analytics, kernel density and training-data operators on Spark DataFrames."""

__version__ = "0.1.0"
VERSION_MAJOR, VERSION_MINOR, VERSION_PATCH = (int(x) for x in __version__.split("."))
