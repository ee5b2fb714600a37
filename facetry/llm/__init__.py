"""Operators for preparing training text: removal of repeats, tokens, quality, toxicity, language models, chats."""
