"""Readers: each turns one raw format into rows of DOCUMENT, split by file or range so that a cluster reads in parallel."""

DOCUMENT = "external_id string, title string, text string, content_type string, parent_id string, depth int, privacy_level int"
