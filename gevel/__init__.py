"""Building analytics on Spark: footprints, registries and 3D tiles in, features and labels out."""
