"""Column functions: text analysis, URLs and HTML, integer codecs."""
