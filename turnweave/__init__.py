"""Speaker-attributed transcripts, and their fusion, as lazy Spark plans."""
