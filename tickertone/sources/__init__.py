"""Feed documents, feed registry, article topic and scored store."""
