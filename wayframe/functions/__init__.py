"""Scalar functions: field paths and conditions."""
