"""Training-data operators: fingerprints, deduplication, licences, language, packing, mixing, personal data.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
