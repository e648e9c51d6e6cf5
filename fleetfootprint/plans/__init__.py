"""Whole queries composed from sources and operators."""
