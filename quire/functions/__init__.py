"""Part of the document analytics engine."""
