"""loomquill: Spark-first analytics for large archives of transcripts and other long texts."""
