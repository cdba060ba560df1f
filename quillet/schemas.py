"""Explicit schemas of the engine's own tables (DDL)."""

SONGS = "id long, title string, artist string, album string, genre string, year int, lyrics_snippet string, full_lyrics string, url string, duration string, language string, embedding array<float>"
NEWS = "id long, title string, date string, snippet string"
POINTS = "id long, x double, y double, z double, title string, artist string, genre string, role string"
CATALOG = "title string, artist string"
LEXICON = "word string, freq int"
PACKED = "titol_canco string, text_embedding string"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
