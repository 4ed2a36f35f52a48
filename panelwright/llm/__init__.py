"""Training-data operators: dedup, secrets, fingerprints, language, licences,
archives, near-dedup, tokenising, toxicity and source mixing.

Nothing outside this subpackage imports it.
"""
