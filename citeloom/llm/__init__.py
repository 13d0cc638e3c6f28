"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; its queries are
registered by ``citeloom.llm.registry``.
"""
