"""larder: Spark jobs for recipe corpora, ingredient resolution and training-data preparation."""
