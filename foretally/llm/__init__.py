"""Training-data operators: duplicates, fingerprints, licences, language, quality, leaks, mixing."""
