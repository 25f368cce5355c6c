"""Column functions of the model: canonical reads, k-mer codes, scores, length priors."""
