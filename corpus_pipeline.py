"""The corpus pipeline; its stages are in sparkwarden.llm.pipeline."""

from sparkwarden.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
