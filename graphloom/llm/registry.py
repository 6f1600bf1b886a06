"""Registered queries of this subpackage and their oracle SQL, by operator module."""

from . import ann, chat_format, mixing, packing, secret_scan, sharding, simhash, syncmers, toxicity, url_filter

_MODULES = (chat_format, packing, ann, sharding, toxicity, syncmers, mixing, secret_scan, simhash, url_filter)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
