"""termweave: translation-consistency analytics expressed as Spark DataFrame plans."""
