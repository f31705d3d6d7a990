"""DataFrame operators: ingest gate, reports, rankings, power laws and movement profiles."""
