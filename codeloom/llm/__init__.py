"""Training-data operators: language, media, toxicity, privacy, near copies, quality,
tokens, language models, archives and benchmark leaks.

Nothing outside this folder imports it.  ``registry`` holds the queries.
"""
