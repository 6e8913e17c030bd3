"""Training-data operators: toxicity, tokens, chat, search, privacy, copies, pages, leaks, shards, licences."""
