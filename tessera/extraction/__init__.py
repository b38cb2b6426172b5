"""From source texts to declarations, imports and call sites, one file at a time; names are resolved later by joins."""
