"""Readers and writers of record logs, result folders, registers, labels and reports."""
