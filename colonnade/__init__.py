"""Typed columnar analytics on Spark: pure Column builders that Catalyst plans.

`operators` holds the kernel families, `functions` statistics and strings,
`plans` the frame facade and the query catalogue, `sources` table access and
`streaming` helpers for unbounded inputs.
"""
