"""Small constructors for literal fixtures."""

TURN = "recording string, turn_idx long, speaker string, start double, end double, text string, confidence double"


def turns(spark, rows, recording="r"):
    """rows of (speaker, start, end, text[, confidence])."""
    return spark.createDataFrame([(recording, i, s, float(a), float(b), t, float(c[0]) if c else 0.5) for i, (s, a, b, t, *c) in enumerate(rows)], TURN)


def many(spark, by_recording):
    """{recording: rows} as one frame."""
    rows = [(r, i, s, float(a), float(b), t, float(c)) for r, x in by_recording.items() for i, (s, a, b, t, c) in enumerate(x)]
    return spark.createDataFrame(rows, TURN)


def listed(df, *columns, order=("recording", "turn_idx")):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*[o for o in order if o in df.columns]).collect()]
