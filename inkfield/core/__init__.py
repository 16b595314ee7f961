"""Pure-Python cores that run inside one region: no Spark imports here."""
