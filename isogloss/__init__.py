"""Table jobs over large corpora of two close language varieties, and over training data at large."""
