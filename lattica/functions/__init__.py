"""Scalar and vector expressions that the operators share."""
