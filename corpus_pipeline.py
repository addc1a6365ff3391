"""The corpus pipeline: STAGES, ORACLE_SQL and run(spark, sf_dir) of ``rasterloom.llm.pipeline``."""

from rasterloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
