"""Training-data operators: deduplication, language ID, decontamination, PII,
WARC writing, licence scans, packing and similarity joins.  Nothing outside
this subpackage imports it."""
