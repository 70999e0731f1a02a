"""riftline: change-point, segment and corpus analytics expressed as Spark plans."""
