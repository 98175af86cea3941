"""Training-data operators: deduplication, sanitising, quality, extraction,
licence scans, mixing and packing. Each module holds one operator; ``queries``
binds them to the driver's tables. Nothing outside this subpackage imports it."""
