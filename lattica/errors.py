"""Errors of data that is no valid graph."""


class GraphFormatError(ValueError):
    """An adjacency matrix that isn't symmetric, or a Laplacian that isn't one."""
