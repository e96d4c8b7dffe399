"""pixelweft: scribble-guided image segmentation as Spark data processing."""
