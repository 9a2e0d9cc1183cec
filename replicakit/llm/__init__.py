"""Operators for preparing training data: text, embeddings and labels at scale.

Nothing else in the library imports this subpackage. Each operator has a module;
``queries`` registers one query per operator.
"""
