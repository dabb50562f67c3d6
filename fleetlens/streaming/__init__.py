"""Structured Streaming jobs; each ends in the state its batch twin computes."""
