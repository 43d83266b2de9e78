"""scriptorium: document conversion, task-ledger analytics and retrieval as Spark jobs.

Subpackages: ``functions`` (column expressions), ``operators`` (ledger, state machine, documents,
retrieval), ``sources`` (files, topics, graph/JDBC stores), ``streaming`` (Structured Streaming
jobs), ``plans`` (skew-safe helpers, derived inputs, registered queries and their oracles).
"""

__version__ = "0.1.0"
