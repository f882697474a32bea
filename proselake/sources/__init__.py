"""Readers and writers: folders of texts, manifests, HTML, EPUB, CoNLL-U, profiles, reports."""
