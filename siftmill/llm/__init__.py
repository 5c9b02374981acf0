"""Training-data operators over document, page and vector tables. Nothing outside imports this."""
