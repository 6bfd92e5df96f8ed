"""Where documents, rejects and signatures go."""
