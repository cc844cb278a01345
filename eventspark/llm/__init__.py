"""Operators of a training-data pipeline, apart from the event library; nothing else imports this package."""
