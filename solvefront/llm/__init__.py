"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; :mod:`solvefront.llm.queries` binds the operators
to the driver tables.
"""
