"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame. They are defined in
tracelink/llm/pipeline.py, with what they promise.
"""

from tracelink.llm.pipeline import ORACLE_SQL, STAGES, decontamination_stage, near_duplicate_stage, packing_stage, repeated_passage_stage, run, toxicity_stage

__all__ = ["ORACLE_SQL", "STAGES", "decontamination_stage", "near_duplicate_stage", "packing_stage", "repeated_passage_stage", "run", "toxicity_stage"]
