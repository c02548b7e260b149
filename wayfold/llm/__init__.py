"""Operators for large text corpora: sharding, fingerprints, token counts,
mixing, exact search, extraction, URL rules, BPE, toxicity, near copies,
ranked search, clustering and packing."""
