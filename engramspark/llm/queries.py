"""The registered query of each corpus operator, and SQL where SQL can express it."""

from __future__ import annotations

from . import exact_dedup, fertility, hmm, ngram_join, packing, pieces, quality, secrets, toxicity, warc

QUERIES = {
    "op1_signature_tree_join": ngram_join.query,
    "op2_seekable_warc": warc.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_best_fit_packing": packing.query,
    "op5_fourier_quality": quality.query,
    "op6_hmm_scoring": hmm.query,
    "op7_fertility_rules": fertility.query,
    "op8_noisy_channel_toxicity": toxicity.query,
    "op9_suffix_array_pieces": pieces.query,
    "op10_secret_scans": secrets.query,
}

ORACLE = {
    "op1_signature_tree_join": ngram_join.ORACLE,
    "op2_seekable_warc": warc.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
}
