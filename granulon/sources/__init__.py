"""Readers of manifests, images, flows and annotations, and writers of the same and of reports."""
