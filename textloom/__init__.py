"""textloom: document analytics and retrieval as Spark DataFrame plans."""
