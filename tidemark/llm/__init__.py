"""Training-data operators: dedup, sharding, quality, BPE, PII, URL filters, packing, HTML, audio.

Nothing outside this folder imports it.
"""
