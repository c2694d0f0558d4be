"""Control plane: batches, manifests, seeds, engines."""
