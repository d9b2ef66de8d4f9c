"""Training-data operators: filters, fingerprints, mixing and scans over document tables."""
