"""Lenses over the benchmark tables and the catalogue of queries."""

from tidemark.plans import captures, catalogue, crawling, digests, extraction, guards, keeping, publishing, reports, spending, streams, verifying  # noqa: F401  (they register their queries in the catalogue)
