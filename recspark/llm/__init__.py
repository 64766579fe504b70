"""Training-data operators: cleaning, deduplication, scoring, tokens, search. Nothing else in the library imports this package."""
