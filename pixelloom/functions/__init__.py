"""functions of the pixel and feature analytics engine."""
