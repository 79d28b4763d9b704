"""Streaming of symbolstrata."""
