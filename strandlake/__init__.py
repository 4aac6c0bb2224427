"""A PySpark engine for biological sequences and motifs as distributions over k-mers."""
