"""Training-data operators: packing, counting, filtering, redaction, joining, mixing, storage and media."""
