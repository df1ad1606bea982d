"""Column-to-column and DataFrame-to-DataFrame operators of the safety dataflow."""
