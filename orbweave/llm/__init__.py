"""Training-data operators: the ten text operators of the README, beside the density engine.

Nothing outside this subpackage imports it, and it imports nothing of the rest of the library.
"""
