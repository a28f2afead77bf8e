"""Operators of a training-data pipeline (one module per operator).

Nothing else in the package imports this folder; ``queries.py`` registers its
queries and ``__spark_entry__.py`` adds them when the folder is present.
"""
