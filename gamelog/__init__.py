"""gamelog: Spark jobs and DataFrame operators for live game event data.

Subpackages: ``functions`` (column expressions), ``sources`` (schemas, codecs, tables),
``operators`` (batch operators), ``streaming`` (Structured Streaming jobs), ``plans``
(registered queries and their SQL oracles).
"""
