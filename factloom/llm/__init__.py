"""Operators for preparing training corpora. Each module is one operator; ``queries`` registers them."""
