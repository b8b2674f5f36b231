"""Whole stages, composed from sources, functions and operators."""
