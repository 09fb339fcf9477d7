"""siterank: DataFrame operators for building and searching documentation-site corpora."""
