"""Operators over streams of packets. Order is explicit: streams are partitioned by their id and ordered by seq."""
