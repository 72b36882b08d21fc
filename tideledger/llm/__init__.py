"""Training-data operators over text corpora; self-contained, imported by nothing else in the package."""
