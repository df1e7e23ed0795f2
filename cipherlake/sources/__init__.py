"""Sources: files, manifests, certificates, stored scans."""
