"""Reading and writing catalogs: constraint snapshots, lake files, bundles, reports."""
