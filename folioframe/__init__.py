"""folioframe: document-asset analytics expressed as Spark plans."""
