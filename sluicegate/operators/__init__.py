"""Record checks, the check chain, the key store, reports and histograms."""
