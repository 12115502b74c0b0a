"""claimlens: document verification and training-data operators as Spark plans."""
