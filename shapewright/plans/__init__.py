"""The queries of the schema-inference operators and their oracles in SQL."""

from shapewright.plans import inference, modelling, words

QUERIES: dict = words.QUERIES | inference.QUERIES | modelling.QUERIES
ORACLES: dict = words.ORACLES | inference.ORACLES | modelling.ORACLES
