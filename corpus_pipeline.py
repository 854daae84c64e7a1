"""The corpus pipeline; its stages are in ``pulsegate.llm.pipeline``."""
from pulsegate.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
