"""Column expressions: text keys, scores and lexicon tables."""
