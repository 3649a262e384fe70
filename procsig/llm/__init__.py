"""Training-data operators: chat formatting, near-duplicates, LM scores, decontamination, token
counts, licence and secret scans, quality rules, byte-level BPE, URL filters, source divergence,
importance resampling and toxicity.

Nothing else in the library imports this subpackage; it may use the library's general helpers.
"""
