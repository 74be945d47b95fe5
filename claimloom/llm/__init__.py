"""Operators that prepare training text: extraction, filters, deduplication, packing.

Nothing else in the package imports this one. Every operator takes DataFrames
and reads only the columns it names; further columns, whatever they are called,
are left alone. A null text counts as an empty one.
"""
