"""Training-data operators: toxicity, decontamination, tokenizing, URL
filters, chat formatting, near-dedup, quality, nearest neighbours, language
identification and line dedup. Nothing else in the library imports this
subpackage; ``queries.py`` holds its registered queries.
"""
