"""Operators of symbolstrata."""
