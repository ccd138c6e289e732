"""Training-data operators: deduplication, decontamination, scoring, mixing and token output.

Nothing outside this subpackage imports it.
"""
