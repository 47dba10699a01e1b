"""Column functions: geography, text rules, URLs, boxes, vectors."""
