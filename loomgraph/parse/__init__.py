"""Source parsers: text of one file in, plain records out. They run in Python workers."""
