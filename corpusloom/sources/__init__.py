"""Readers and writers of the text formats that the operators take and give."""
