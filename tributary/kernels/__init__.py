"""Sequential per-document algorithms in plain Python; they know nothing of Spark."""
