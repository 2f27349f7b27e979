"""Incremental work: files that arrive are taken in once."""
