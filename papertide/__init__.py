"""Bibliometric analytics on Spark: records, matching, counting rules, rankings, graphs and text scoring as DataFrame operators."""
