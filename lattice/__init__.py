"""lattice: document, vector, time-coded and event analytics as Spark plans."""
