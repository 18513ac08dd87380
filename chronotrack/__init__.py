"""Analytics over high-rate timestamp streams, detection tracks, frames and audio, as Spark DataFrame functions."""
