"""The training-corpus pipeline: quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing."""

from __future__ import annotations

from rolefit.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, line_dedup, near_dedup, packing, quality, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "line_dedup", "near_dedup", "packing", "quality", "run"]
