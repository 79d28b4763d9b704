"""Sources of symbolstrata."""
