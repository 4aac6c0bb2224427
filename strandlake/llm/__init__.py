"""Training-data operators: deduplication, filtering, tokenisation, mixing and storage.

Nothing outside this subpackage imports it.  ``queries`` registers one
``opN_<name>`` query per operator.
"""
