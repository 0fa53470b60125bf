"""DataFrame operators: sections, sentences, selections, reports, catalogue."""
