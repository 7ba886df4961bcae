"""Readers and writers: job tables, log archives, labelled corpora, results."""
