"""Operators of a large-scale text pipeline (URL rules, decontamination, packing, extraction, dedup, language, toxicity)."""
