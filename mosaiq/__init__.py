"""A PySpark engine for directories of organisations: harvest, merge, conform, suppress, browse, score."""
