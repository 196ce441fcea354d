"""Command line: speaker-attributed transcripts of media files, of stored results, or of two recordings fused.

Recognition and diarization models are adapters: --recogniser and --diarizer name them as module:function, where the
function, called without arguments on an executor, returns the model (turnweave.sources.speech says what models take and
return).  Instead of running models, stored results can be read: a folder with <recording>.json for each recording, or a
capture folder.
"""

from __future__ import annotations

import argparse
import importlib
import inspect
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stamp_seconds, stem
from .operators import duplicates, reports
from .plans import pipelines
from .sources import capture, markdown, media, speech
from .sources.scratch import Scratch

DIARIZED = "tracks array<struct<start: double, end: double, label: string>>, labels array<string>, embeddings array<array<double>>"
#: Options that only models use.
OF_MODELS = ("model", "language", "prompt", "verbose")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turnweave", description="speaker-attributed transcripts as Markdown")
    p.add_argument("media", nargs="?", help="a folder of media files or one file; default ./data")
    p.add_argument("--recogniser", metavar="MODULE:FUNCTION", help="makes the speech recogniser")
    p.add_argument("--diarizer", metavar="MODULE:FUNCTION", help="makes the diarizer")
    p.add_argument("--model", help="the recogniser's model, by default turbo; in TURNWEAVE_MODEL for the function")
    p.add_argument("--language", help="a language code, by default en, or auto")
    p.add_argument("--prompt", help="text that the recogniser starts from")
    p.add_argument("--verbose", action="store_true", default=None)
    p.add_argument("--num-speakers", type=int)
    p.add_argument("--output-dir")
    p.add_argument("--preprocess", action="store_true", help="clean the audio first")
    p.add_argument("--denoise", action="store_true", help="as --preprocess, with noise reduction")
    p.add_argument("--audio-filter", help="this filter chain instead")
    p.add_argument("--asr", help="folder of recogniser results, one JSON file a recording")
    p.add_argument("--diarization", help="folder of diarizer results, one JSON file a recording")
    p.add_argument("--fuse", metavar="MEDIA", help="a second recording of the same meeting; the first must be a single file")
    p.add_argument("--capture", metavar="FOLDER", help="with --fuse: keep all intermediate tables there")
    p.add_argument("--fuse-capture", metavar="CAPTURE", help="fuse the two sides of a capture folder")
    p.add_argument("--sounds", help="Parquet of (recording, side, rate, samples) for the clock offset of --fuse-capture")
    p.add_argument("--report", metavar="TRANSCRIPTS", help="measure rendered transcripts, a file or a folder")
    p.add_argument("--render-capture", metavar="CAPTURE", help="render a captured fusion again")
    p.add_argument("--no-guard", action="store_true", help="with --render-capture: keep turns that a neighbour's new text holds")
    p.add_argument("--smooth", action="store_true", help="join stray words without duration to the turns around them")
    return p


def chosen_filter(args: argparse.Namespace) -> str | None:
    if args.audio_filter:
        return args.audio_filter
    return media.audio_filter(args.denoise) if args.preprocess or args.denoise else None


def named(spec: str, model: str | None = None):
    """A function that imports module:function where it is called, with the model's name in the environment.

    A function with a parameter token gets the user's credential, looked up here, and its failures say what to do.
    """
    module, _, function = spec.partition(":")
    asks = "token" in inspect.signature(getattr(importlib.import_module(module), function)).parameters
    token = media.resolve_token() if asks else None
    if asks and not token:
        speech.load_diarizer(lambda _: None, None, ("the environment's HF_TOKEN", ".env here", "~/.config/turnweave/.env"))

    def make():
        if model:
            os.environ["TURNWEAVE_MODEL"] = model
        load = getattr(importlib.import_module(module), function)
        return speech.load_diarizer(lambda t: load(token=t), token) if asks else load()

    return make


def keeper(kept: list[DataFrame]):
    """Persists a frame and notes it, so that it can be let go."""

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return df

    return keep


def from_media(spark: SparkSession, args: argparse.Namespace, folder: str, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recording, segments), (recording, tracks ...), and (recording, error) of the media files."""
    keep = keeper(kept)
    files = keep(media.scan_media(spark, args.media).withColumn("recording", stem(F.col("path"))))
    n, names = files.count(), files.select("recording").distinct().count()
    if not n:
        raise ValueError(f"no media files found in {args.media or media.default_input_dir()}")
    if names < n:
        raise ValueError("two media files have the same name but for their endings; transcribe them apart")
    if args.media is not None and n == 1 and not os.path.exists(files.first()["path"].removeprefix("file:")):
        raise FileNotFoundError(f"no such file: {args.media}")
    clean = keep(media.extract_audio(files, os.path.join(folder, ".clean"), chosen_filter(args)).join(files, "path"))
    ready = clean.where("error is null").select("recording", F.col("cleaned").alias("path"))
    language = None if args.language == "auto" else args.language or "en"
    make = named(args.recogniser, media.resolve_model(args.model or "turbo"))
    heard = keep(speech.transcribe(ready, make, language, args.prompt, args.verbose))
    found = keep(speech.diarize(ready, named(args.diarizer), args.num_speakers))
    failed = clean.select("recording", "error").unionByName(heard.select("recording", "error")).unionByName(found.select("recording", "error"))
    failed = keep(failed.where("error is not null").groupBy("recording").agg(F.min("error").alias("error")))
    good = lambda df: df.join(failed, "recording", "left_anti")
    return good(heard.drop("error")), good(found.drop("error")), failed


def stored(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = spark.read.schema(DIARIZED).option("multiLine", True).json(args.diarization)
    found = found.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("recording"), "*")
    return speech.read_asr(spark, args.asr), found, spark.createDataFrame([], "recording string, error string")


def transcripts(spark: SparkSession, args: argparse.Namespace, folder: str) -> int:
    """Writes single transcripts; 1 if a recording failed."""
    kept: list[DataFrame] = []
    try:
        return write_all(*(from_media(spark, args, folder, kept) if args.recogniser else stored(spark, args)), args, folder, kept)
    finally:
        for df in kept:
            df.unpersist()


def write_all(heard: DataFrame, found: DataFrame, failed: DataFrame, args: argparse.Namespace, folder: str, kept: list[DataFrame]) -> int:
    keep = keeper(kept)
    errors = [f"{r['recording']}: {r['error']}" for r in failed.orderBy("recording").collect()]
    words, turns = speech.flatten_words(heard), speech.diarization_turns(found)
    # a recording with words and no turns cannot be aligned; that is its own failure
    lost = keep(words.select("recording").distinct().join(turns.select("recording").distinct(), "recording", "left_anti"))
    errors += [f"{r['recording']}: no speaker turns to align with" for r in lost.orderBy("recording").collect()]
    out = pipelines.transcribe_recordings(words.join(lost, "recording", "left_anti"), turns, smooth=args.smooth)
    asked = keep(heard.select("recording").distinct().join(lost, "recording", "left_anti"))
    silent = markdown.write_transcripts(out.markdown, folder, ".md", expected=asked)
    errors += [f"{name}: no speech found" for name in silent]
    notes = pipelines.shown(out.diagnostics)
    if args.num_speakers is not None:
        notes += [f"warning: {r['recording']}: {r['message']}" for r in speech.speaker_count_warnings(found, args.num_speakers).orderBy("recording").collect()]
    for line in (*notes, *(f"error: {e}" for e in errors)):
        print(line, file=sys.stderr)
    out.close()
    total = asked.count() + lost.count() + failed.count()
    print(f"Done. {total - len(errors)}/{total} recording(s) transcribed, in {folder}.")
    return 1 if errors else 0


def fuse_media(spark: SparkSession, args: argparse.Namespace, folder: str) -> int:
    """Writes <first file's stem>.fused.md of two recordings of one meeting, and their tables if asked; 1 if that failed."""
    if args.media is None or os.path.isdir(args.media):
        raise ValueError("--fuse needs a single media file beside it, not a folder or the default folder")
    for path in (args.media, args.fuse):
        if not os.path.exists(path):
            raise FileNotFoundError(f"no such file: {path}")
    if not args.recogniser:
        raise ValueError("--fuse runs models on both recordings: give --recogniser and --diarizer")
    name = os.path.splitext(os.path.basename(args.media))[0]
    pairs = spark.createDataFrame([(name, args.media, args.fuse)], "recording string, a string, b string")
    scratch, language = Scratch(spark), None if args.language == "auto" else args.language or "en"
    filters = chosen_filter(args)
    if filters:
        print(f"cleaning the audio with {filters}")
    try:
        recogniser, diarizer = named(args.recogniser, media.resolve_model(args.model or "turbo")), named(args.diarizer)
        tables, sounds, failed = pipelines.hear_both_sides(pairs, recogniser, diarizer, os.path.join(folder, ".clean"), scratch, filters, language, args.prompt, args.verbose, args.num_speakers)
        errors = [f"error: {r['recording']}: {r['error']}" for r in failed.collect()]
        if not errors:
            out = pipelines.fuse(tables, sounds, smooth=args.smooth)
            notes = out.diagnostics if args.num_speakers is None else out.diagnostics.unionByName(pipelines.count_warnings(tables, args.num_speakers))
            if args.capture:
                capture.write_capture(args.capture, tables | out.steps)
            markdown.write_transcripts(out.markdown, folder, ".fused.md", allow_empty=True)
            errors = pipelines.shown(notes)
            out.close()
    finally:
        scratch.close()
    for line in errors:
        print(line, file=sys.stderr)
    if any(line.startswith("error") for line in errors):
        return 1
    print(f"Fused transcript written to {os.path.join(folder, name)}.fused.md")
    return 0


def report(spark: SparkSession, path: str, k: int = 10) -> list[str]:
    """Lines on the quality of rendered transcripts: fragments, loops, words that stand out, and repeated passages."""
    blocks = markdown.read_transcripts(spark, path).withColumnRenamed("block_idx", "turn_idx")
    turns = blocks.select("recording", "turn_idx", "speaker", stamp_seconds(F.col("stamp")).cast("double").alias("start"), "text").persist()
    try:
        lines = []
        for r in reports.fragmentation(turns).orderBy("recording").collect():
            lines += [f"{r['recording']}: {r['blocks']} blocks, {r['words']} words; blocks of at most 1, 2, 3, 5 words: {r['le_1']}, {r['le_2']}, {r['le_3']}, {r['le_5']}; {r['sandwiched']} between two of one other speaker; {r['same_as_before']} after one of their own speaker"]
        lines += [f"{r['recording']}: {r['short']} blocks of at most two words, {r['squashed']} of them acknowledgements ({r['by_word']} by the smoothing's rule)" for r in reports.backchannel_split(turns).orderBy("recording").collect()]
        lines += [f"short texts, {'acknowledgements' if r['backchannel'] else 'others'}: '{r['token']}' {r['n']} times" for r in reports.top_short_texts(turns).orderBy(F.desc("backchannel"), "place").collect()]
        within = reports.degeneration_within(turns).agg(F.count("*").alias("n")).first()["n"]
        lines.append(f"blocks with one word four times in a row: {within}")
        lines += [f"across blocks: '{r['token']}' {r['count']} times in a row in {r['recording']}" for r in reports.degeneration_docwide(turns).collect()]
        lines += [f"stands out: '{r['token']}' {r['n']} times" for r in reports.suspicious_tokens(turns).collect()]
        lines += [f"passages repeated {r['distance']} blocks apart, {'one speaker' if r['same_speaker'] else 'two speakers'}: {r['n']}" for r in reports.redundancy(turns).orderBy("distance", "same_speaker").collect()]
        top = duplicates.top_duplicates(duplicates.cross_speaker_duplicates(turns), k).collect()
        lines += [f"{r['recording']}: {r['first_speaker']} and {r['second_speaker']} share {r['shared_chars']} characters, {r['distance']} blocks apart" for r in top]
        return lines + ([f"  ... and {top[0]['n_more']} more"] if top and top[0]["n_more"] else [])
    finally:
        turns.unpersist()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        unused = [f"--{o}" for o in OF_MODELS if getattr(args, o) is not None]
        if unused and not args.recogniser:
            raise ValueError(f"{', '.join(unused)}: only a recogniser uses this, and no recogniser is run on stored results; give --recogniser")
        if bool(args.recogniser) != bool(args.diarizer):
            raise ValueError("--recogniser and --diarizer go together")
        spark = SparkSession.builder.appName("turnweave").getOrCreate()
        if args.capture and not args.fuse:
            raise ValueError("--capture goes with --fuse")
        if args.fuse:
            return fuse_media(spark, args, media.resolve_output_dir(args.output_dir))
        if args.report:
            print("\n".join(report(spark, args.report)))
            return 0
        if args.fuse_capture or args.render_capture:
            tables = capture.read_capture(spark, args.fuse_capture or args.render_capture)
            folder = media.resolve_output_dir(args.output_dir)
            if args.render_capture:
                rendered, notes = pipelines.render_capture(tables, guard=not args.no_guard), []
            elif not args.sounds:
                raise ValueError("--fuse-capture needs --sounds for the clock offset")
            else:
                out = pipelines.fuse(tables, pipelines.envelopes(spark.read.parquet(args.sounds)), smooth=args.smooth)
                rendered, notes = out.markdown, pipelines.shown(out.diagnostics)
            markdown.write_transcripts(rendered, folder, ".fused.md", allow_empty=True)
            for line in notes:
                print(line, file=sys.stderr)
            print(f"written to {folder}")
            return 1 if any(line.startswith("error") for line in notes) else 0
        if args.recogniser or (args.asr and args.diarization):
            return transcripts(spark, args, media.resolve_output_dir(args.output_dir))
        raise ValueError("no recogniser is built in: give --recogniser and --diarizer, or --asr and --diarization, or --fuse-capture, or --report")
    except Exception as problem:  # noqa: BLE001  the exit code tells the caller
        print(f"turnweave: {problem}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
