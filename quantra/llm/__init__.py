"""Training-data operators: search, redaction, deduplication, decontamination, mixing, filters, token files."""
