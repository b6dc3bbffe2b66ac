"""quern: document analytics on Apache Spark, written as DataFrame plans."""
