"""Table operators of the imaging metadata jobs."""
