"""Operators for preparing training text: deduplication, cleaning, encoding, packaging. Nothing else imports this package."""
