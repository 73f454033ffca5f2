"""siteloom: a DataFrame-first analytics engine for genomic sites and intervals."""
