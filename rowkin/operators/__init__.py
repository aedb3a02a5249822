"""Table operators: blocking, transliteration, training sets, pair features."""
