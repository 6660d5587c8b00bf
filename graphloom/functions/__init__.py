"""Column functions: three-valued logic, rounding, text, digests."""
