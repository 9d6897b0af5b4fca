"""Model objects: ranges, targets, correlators, emulators and collections of them."""
