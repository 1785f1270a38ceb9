"""Readers: files of a checkout, graph documents, labels, anchors, questions, configuration, provenance."""
