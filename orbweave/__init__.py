"""orbweave: periodic kernel-density analytics on Spark."""
