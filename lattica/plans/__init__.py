"""Inputs that registered queries are planned over."""
