"""keyframe: ordered, fixed-width, key-sorted record sets on PySpark."""
