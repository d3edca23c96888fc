"""Operators for preparing language-model training data. Nothing else in tarn imports this."""
