"""Operators for text collections and their queries; nothing else in the library imports this."""
