"""Corpus operators for training text: boilerplate, residue, near copies, spam, leaks, mixing, quality."""
