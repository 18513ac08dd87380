"""DataFrame operators: pairing, windows, aggregation, fitting, image and track kernels."""
