"""Sources and sinks: trees of files, manifests, lock files, caches, histories, reports."""
