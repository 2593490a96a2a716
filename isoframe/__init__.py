"""isoframe: genomic-interval and RNA-splicing analytics as Spark DataFrame transformations."""
