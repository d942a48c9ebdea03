"""Tessera: search and analytics over documents, vectors and event feeds, as Spark DataFrame plans."""
