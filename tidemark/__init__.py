"""Text, usage and activity analytics as PySpark plans."""
