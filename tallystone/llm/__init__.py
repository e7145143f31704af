"""Training-data operators: near duplicates, fingerprints, tokenizing, quality, language, packing.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
