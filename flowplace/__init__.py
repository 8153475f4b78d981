"""flowplace: communication-graph analytics on recorded message streams, written as Spark jobs."""
