"""Training-data operators: token counts, deduplication, language ID, secrets, mixing, encoding, decontamination, PII."""
