"""Operators for large text corpora: one module per operator, queries in ``queries``.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries only when it can be imported.
"""
