"""ledgerline: complaint analytics expressed as Spark DataFrame plans.

Layers (bronze -> staging -> silver -> gold wide / star -> serving grains)
are plain ``DataFrame -> DataFrame`` functions; analytics, the governed
metric query and narrative text analysis read those layers.
"""

__version__ = "0.1.0"
