"""Part of the masking library."""
