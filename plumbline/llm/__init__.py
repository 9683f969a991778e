"""Training-data operators: URL filters, decontamination, near-dedup, WARC derivatives, sketches,
language ID, BPE, license scans, sharding, PII, collocations, language-model scores and lexical search.  Nothing else in the library imports this package."""
