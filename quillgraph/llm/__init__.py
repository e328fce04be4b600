"""Operators for preparing training text: formatting, filtering, packing, scanning and de-duplication.

Nothing outside this subpackage imports it; its queries are listed in ``quillgraph.llm.queries``.
"""
