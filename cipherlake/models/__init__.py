"""Statistical models over findings, histories and signals."""
