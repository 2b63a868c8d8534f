"""Edges that arrive as files."""
