"""Cell segmentation analytics as Spark plans: label masks and images are relations of pixels."""
