"""Training-data operators: quality, near copies, decontamination, PII, tokens, toxicity, chat, licences, secrets.

Nothing else in the library imports this subpackage.
"""
