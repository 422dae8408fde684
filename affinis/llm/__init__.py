"""Training-data operators: tokenising, language identification, secrets, deduplication,
sharding, toxicity, fingerprints, URL rules and source mixing.

Nothing outside this subpackage imports it.
"""
