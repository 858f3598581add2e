"""Operators for preparing language-model training text. Nothing else in broadsheet imports this package."""
