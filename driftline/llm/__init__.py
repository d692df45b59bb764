"""Training-data operators: mixing, token output, URL and quality rules, fingerprints, tokenizers."""
