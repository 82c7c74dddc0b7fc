"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, language_id, piece_encoding, quality, secrets, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_secrets": secrets.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_language_id": language_id.query,
    "op7_decontaminate": decontaminate.query,
    "op8_piece_encoding": piece_encoding.query,
    "op9_quality": quality.query,
    "op10_warc": warc.query,
}

#: What SQL cannot express is tested against brute force or the tokenizers' libraries in tests/llm.
ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
}
