"""Operators of a training-data pipeline: mixing, dedup, fingerprints, chat, quality, media, URLs, pieces, shards."""
