"""Relational operators over artifacts, findings, links and scans."""
