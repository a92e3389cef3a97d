"""framelake: DataFrame-first analytics for scored, timed and embedded media records."""
