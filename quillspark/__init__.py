"""quillspark: evidence retrieval, briefing assembly and corpus operators on Spark DataFrames."""
