"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Every operator reads only the
columns it is told to and leaves all others alone, so extra columns may have any
name. Each says in its docstring what it does with nulls, empty tables, ties and
repeated rows.
"""
