"""Streaming uses of the batch operators."""
