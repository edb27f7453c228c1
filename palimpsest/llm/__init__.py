"""Training-data operators: language id, dedup, toxicity, decontamination, extraction, packing, URL rules.

Nothing outside this package imports it; the package may be removed without touching the rest.
"""
