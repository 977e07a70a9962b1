"""Operators that prepare text corpora for training. Nothing outside this subpackage imports it, but for the entry point's guard."""
