"""Conservative semantic analytics for technical documents, as Spark plans."""
