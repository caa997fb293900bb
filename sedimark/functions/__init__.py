"""Column functions: bytes, strings, metadata, guards."""
