"""Fieldbook: catalogue, archive and seasonal-presence analytics as Spark DataFrame operators."""
