"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator;
``registry`` holds the thin ``opN_<name>`` queries over them.
"""
