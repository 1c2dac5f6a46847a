"""Structured Streaming forms of the cleaning stage (the reference has no
streaming; these run the same Column functions on a ``readStream``)."""
