"""Training-data operators: text, web page, token and media tables."""
