"""Readers and writers of the files a warehouse tool meets: catalogs, manifests, saved questions, documents, exports."""
