"""parley: a PySpark engine for paired dialogue experiments and large text corpora."""
