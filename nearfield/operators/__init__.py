"""Search, index and evaluation operators."""
