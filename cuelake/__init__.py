"""cuelake: transcript and caption processing over many recordings, as Spark DataFrame operators."""
