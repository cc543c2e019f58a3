"""Where corpora come from and go to: frames, versioned Parquet, a keyed cache."""
