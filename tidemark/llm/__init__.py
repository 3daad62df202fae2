"""Training-data operators: media, secrets, chat, sharding, mixing, search, dedup, packing, language, scoring."""
