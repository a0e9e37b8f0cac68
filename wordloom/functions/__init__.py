"""Column functions: folding, words, patterns, bits, marks."""
