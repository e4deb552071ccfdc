"""Column expressions: genotypes, projection, codons."""
