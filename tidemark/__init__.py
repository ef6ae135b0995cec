"""Disclosure analytics on Spark: claims, figures and wording tracked across successive reports."""
