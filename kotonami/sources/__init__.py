"""Request, payload and page sources."""
