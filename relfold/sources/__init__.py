"""Table folders, delimited files and stored profiles."""
