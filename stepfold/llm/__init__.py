"""Operators for large-scale training-data preparation.

Nothing outside this package imports it.  Each operator lives in a module of
its own with a general interface; :mod:`stepfold.llm.entries` derives the
digest-column queries from them.
"""
