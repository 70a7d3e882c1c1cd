"""Training-data operators: dedup, quality, toxicity, secrets, vector search,
packing, chat formatting and tokenisation over whole corpora."""
