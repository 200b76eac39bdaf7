"""Training, candidate pools and serving."""
