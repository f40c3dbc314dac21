"""Operators for building training corpora: one module per operator.

Nothing outside this folder imports it, except the driver contract, which adds
``tessera.llm.queries`` when the folder is there.
"""
