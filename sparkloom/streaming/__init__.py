"""Structured Streaming forms of the operators that follow a live session or tree."""
