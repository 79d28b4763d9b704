"""Plans of symbolstrata."""
