"""Training-data operators: packing, PII, media, near-duplicates, language, tokens, HTML, neighbours, toxicity."""
