"""Stand-ins for models, named on the command line in tests."""

import os


def recogniser():
    def model(path, **options):
        assert options["language"] == "fr" and options["initial_prompt"] == "names" and options["word_timestamps"] and options["verbose"]
        assert os.environ["TURNWEAVE_MODEL"] == "some/model"
        name = os.path.basename(path)
        if "broken" in name:
            raise OSError("unreadable")
        words = [] if "quiet" in name else [{"word": " hello", "start": 0.0, "end": 0.5, "probability": 0.9}, {"word": " you", "start": 2.0, "end": 2.5, "probability": 0.9}]
        return {"segments": [{"start": 0.0, "end": 3.0, "text": "", "words": words}]}

    return model


def diarizer():
    def model(path, **options):
        assert options == {"num_speakers": 3}
        tracks = [] if "alone" in path else [(0.0, 1.0, "x"), (2.0, 3.0, "y")]
        return {"tracks": tracks, "labels": ["x", "y"], "embeddings": [[1.0], [0.5]]}

    return model


def two_machines():
    """What two machines hear of one meeting: the second, nine seconds later, understands better and misses a turn."""

    def model(path, **options):
        name = os.path.basename(path)
        if "broken" in name:
            raise OSError("unreadable")
        said = [("mumbled", 11.0, 0.2), ("peach", 12.0, 0.3), ("only", 20.0, 0.9), ("here", 21.0, 0.9), ("later", 30.0, 0.6)] if "desk" in name else [("clear", 2.0, 0.9), ("speech", 3.0, 0.9), ("on", 11.0, 0.1), ("later", 21.0, 0.5)]
        return {"segments": [{"start": 0.0, "end": 60.0, "text": "", "words": [{"word": f" {w}", "start": t, "end": t + 0.5, "probability": p} for w, t, p in said]}]}

    return model


def voices_with_token(token):
    assert token

    def model(path, **options):
        first, second, shift = ("x", "y", 0.0) if "desk" in path else ("m", "n", -9.0)
        tracks = [(11.0 + shift, 13.0 + shift, first), (20.0 + shift, 22.0 + shift, second), (30.0 + shift, 31.0 + shift, first)]
        return {"tracks": tracks, "labels": [first, second], "embeddings": [[1.0, 0.1], [0.1, 1.0]]}

    return model
