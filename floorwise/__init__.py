"""floorwise: Spark-native analytics for indoor area-graph maps.

Maps are read in bulk into DataFrames of nodes, ways and tags, every table carrying a
``map_id``; validation, repair, merging, labelling and statistics are declarative plans.
"""

__version__ = "0.1.0"
