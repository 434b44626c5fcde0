"""Part of the sample analytics library."""
