"""arbiter: authority-aware retrieval analytics as lazy Spark plans."""
