"""A corpus pipeline: quality, near-duplicates, personal data, packing; see ``tidemark.llm.stages``."""

from __future__ import annotations

from tidemark.llm.stages import STAGES, run

#: SQL can express neither the model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
