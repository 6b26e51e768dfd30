"""Operators for preparing training text: mixing, deduplication, sharding, language, tokens, toxicity, decontamination, chat, personal data."""
