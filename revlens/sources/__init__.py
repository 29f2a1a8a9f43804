"""Table sources: driver tables, review-shaped views, file IO."""
