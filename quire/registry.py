"""All queries of the library and their SQL."""

from .operators import assembly, bloom, books, boxes, conversion, documents, extensions, images, inference, knowledge, rebuild, rules, usage

MODULES = (documents, knowledge, usage, books, rules, images, assembly, inference, extensions, conversion, bloom, rebuild, boxes)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
