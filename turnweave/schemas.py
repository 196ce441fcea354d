"""Canonical column lists of the data model; every table carries an explicit index, for order is data."""

WORDS = "recording string, word_idx long, word string, start double, end double, probability double"
ALIGNED = WORDS + ", speaker string"
DIARIZATION = "recording string, dturn_idx long, start double, end double, speaker string"
TURNS = "recording string, turn_idx long, speaker string, start double, end double, text string, confidence double"
EMBEDDINGS = "recording string, label_idx long, speaker string, embedding array<double>"
ENVELOPE = "recording string, win_idx long, rms double"
ASR = "segments array<struct<start: double, end: double, text: string, words: array<struct<word: string, start: double, end: double, probability: double>>>>, text string, language string"
