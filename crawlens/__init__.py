"""Corpus-scale audit of how readable web pages and sites are to automated readers."""
