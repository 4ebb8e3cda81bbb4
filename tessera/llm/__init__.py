"""Corpus operators: deduplication, packing, language and quality scoring, extraction.

Nothing outside this folder imports it.  Functions that run on executors are
pickled by reference, so ship the package with ``--py-files`` on a cluster.
"""
