"""Scans of project folders, archives, parsed documents and logs; writers for the same."""
