"""Column functions: bytes, bits, checksums, and fixed dimension tables."""
