"""Training-data operators. Nothing outside this subpackage imports it.

Each operator lives in a module of its own with a general interface; the
registered ``opN_`` queries are thin wrappers in :mod:`quillstream.llm.queries`.
"""
