"""Knowledge-base analytics on Spark: parsing, chunking, retrieval, analytics and streaming as DataFrame plans."""
