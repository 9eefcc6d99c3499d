"""Training-data operators over the documents, pages, benchmark and labels tables.

``registry.QUERIES`` and ``registry.ORACLE_SQL`` hold the queries ``opN_<name>``; nothing outside
this subpackage imports it but the guarded lines of ``__spark_entry__``.
"""
