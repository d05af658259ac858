"""How plans are shaped: sizes that are checked, lookups that survive skew, cut lineage."""
