"""carelake: a healthcare warehouse and its analytics as Spark jobs.

Landing files become all-string staging frames, staging becomes a star
schema, the star schema becomes pre-joined reporting views, and measures,
report datasets and parameterised queries run on those views.
"""
