"""Mass spectrometry imaging analytics as Spark queries."""
