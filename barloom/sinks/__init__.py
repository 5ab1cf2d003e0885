"""Writers of features: pinned CSV artifacts with manifests, chart series, fixed-point listings, streams."""
