"""Training-data operators: language id, decontamination, packing, chat
formatting, URL filters, quality resampling, similarity join, nearest
neighbours, content-addressed WARC and substring deduplication.

Nothing outside this subpackage imports it.
"""
