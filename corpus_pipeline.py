"""The corpus pipeline, as the driver looks for it: see ``snapstats.llm.pipeline``."""

from snapstats.llm.pipeline import ORACLE_SQL, STAGES, decontamination, line_dedup, near_dedup, pack, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "decontamination", "line_dedup", "near_dedup", "pack", "quality_rules", "run"]
