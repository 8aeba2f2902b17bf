"""Standing queries over growing folders of reports."""
