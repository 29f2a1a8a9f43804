"""Training-data operators (HTML, tokens, secrets, near duplicates, mixing,
personal data, decontamination, WARC, language).  Nothing else in the
repository imports this package; ``__spark_entry__`` adds its queries when
it is present."""
