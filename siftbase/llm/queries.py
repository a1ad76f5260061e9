"""All registered queries of this subpackage."""

from siftbase.llm import alignment, exact_dedup, fill_middle, language_id, lm_score, mixing, near_dup, neighbours, packing, quality, suffix_dedup, token_files, warc  # noqa: F401
from siftbase.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
