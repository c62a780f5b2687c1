"""quire: Spark-native analytics over large collections of paged text documents.

The library is a set of ``DataFrame -> DataFrame`` operators and ``Column``
functions.  Nothing here starts a service; sessions, tables and sinks belong to
the caller.
"""
