"""Operators for preparing training data. Nothing outside this folder, its tests and the corpus pipeline imports it."""
