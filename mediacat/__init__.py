"""mediacat: media-catalog analytics as Spark DataFrame plans."""
