"""Training-data operators: extraction, deduplication, quality, licences, mixing, packing, languages, media."""
