"""Functions of symbolstrata."""
