"""Structured Streaming forms of the operators that follow a video as it comes."""
