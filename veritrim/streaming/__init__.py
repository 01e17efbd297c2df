"""Structured Streaming jobs over growing sample and result folders."""
