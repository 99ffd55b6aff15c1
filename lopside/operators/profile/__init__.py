"""Meta-features of a labelled table, by group."""
