"""Record linkage on Spark, written as DataFrame programs."""
