"""Training-data pipeline operators: packing, dedup, scans, scoring, encoding, extraction."""
