"""Training-data operators: packing, URL rules, language, scoring, fingerprints, search, mixing, secrets, dedup."""
