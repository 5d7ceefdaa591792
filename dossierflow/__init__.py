"""Document intelligence on Spark: land, parse, classify, extract, de-identify, track."""

from dossierflow.settings import Settings

__all__ = ["Settings"]
