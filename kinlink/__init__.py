"""Record linkage on Spark: normalisation, blocking, pair features, scoring, policies and their evaluation."""
