"""Dossier: document-evidence analytics on Spark DataFrames."""
