"""Training-data operators: fingerprints, personal data, quality, near duplicates, packing, secrets, BPE, id files, toxicity.

Nothing else in the library imports this subpackage.
"""
