"""larkspur: Spark-native analytics for budgeted, long-tail-conscious selection of images to annotate."""
