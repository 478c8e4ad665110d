"""Readers: files, REST responses, payloads and HTML pages."""
