"""textmill: document, retrieval and tabular analytics as Spark DataFrame jobs.

Layout
------
``functions``  column-level building blocks (regex predicates, tokens, hashes, vector math)
``operators``  ``DataFrame -> DataFrame`` transformations (cleaning, chunking, heading tree,
               versioned ingest, embeddings, vector search, log analytics, SQL surface)
``sources``    readers and writers (binary files, chunk JSON, Parquet, CSV, sandbox catalog)
``plans``      the registered queries over the driver tables and their DuckDB oracles
``streaming``  Structured Streaming variants of the staging ingest
"""

from textmill.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
