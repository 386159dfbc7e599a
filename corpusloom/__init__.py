"""Text and weighted-rule analytics as DataFrame-to-DataFrame functions on Spark."""
