"""Structured Streaming jobs (L1-L3) and the rate audit (E5)."""
