"""Vector files, ground truth and stored indexes."""
