"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; ``llm.queries`` registers
one query per operator.
"""
