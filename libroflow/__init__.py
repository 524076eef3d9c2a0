"""Analytics for transcribed registers, as DataFrame-to-DataFrame functions on Spark."""
