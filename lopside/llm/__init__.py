"""Operators for preparing training text: dedup, cleaning, scoring, mixing, packing, archives.

Nothing else in the library imports this package. ``queries`` registers one query per operator.
"""
