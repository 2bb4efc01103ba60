"""Readers and writers: lines of JSON with keys, feeds in XML, records of services, files with fingerprints."""
