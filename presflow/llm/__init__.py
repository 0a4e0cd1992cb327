"""Training-data operators: tokens, language, duplicates, mixing, sharding, fingerprints and nearest neighbours."""
