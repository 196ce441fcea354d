"""Clock offset of two recordings from their loudness envelopes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "recording"
WINDOW_SECONDS, RIVAL_SECONDS, MIN_OVERLAP, WEAK = 0.1, 5.0, 0.5, 1.2
#: Windows of a segment, and thousands (of 1,024) of numbers of all segments' transforms that a task takes together.
SEGMENT, SHARE = 4096, 64
#: Ranges of values that the middle one is looked for in.
RANGES = 4096


def rms_envelope(samples: DataFrame, window: int) -> DataFrame:
    """recording, win_idx, rms of samples (recording, sample_idx, value); a last window that is not full is dropped."""
    grouped = samples.groupBy(KEY, F.floor(F.col("sample_idx") / window).alias("win_idx"))
    x = F.col("value").cast("double")
    return grouped.agg(F.sqrt(F.avg(x * x)).alias("rms"), F.count("*").alias("_n")).where(F.col("_n") == window).drop("_n")


def rms_envelope_chunked(chunks: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """As rms_envelope, for rows (recording, rate, samples array) that hold a whole recording each, or, with the column start
    (the index of a row's first sample), whole windows of it; a start inside a window is an error.
    """
    window = F.greatest(F.lit(1), F.floor(F.col("rate") * window_seconds)).cast("int")
    count = F.floor(F.size("samples") / window).cast("int")
    cut = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda i: F.slice("samples", (i * window + 1).cast("int"), window))
    square = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(w))
    start = F.col("start") if "start" in chunks.columns else F.lit(0).cast("long")
    first = F.when(start % window == 0, F.floor(start / window)).otherwise(F.raise_error(F.lit("a chunk starts inside a window")).cast("long"))
    usable = chunks.where(F.size("samples") >= window).select(KEY, first.alias("_first"), F.transform(cut, square).alias("_rms"))
    return usable.select(KEY, "_first", F.posexplode("_rms").alias("_at", "rms")).select(KEY, (F.col("_first") + F.col("_at")).alias("win_idx"), "rms")


def _segments(pairs: DataFrame, center: bool, segment: int) -> DataFrame:
    """pair_id, side, seg, n_a, n_b, at, v: the segments of both sides; a segment meets its pair's sizes by its own number, so that no
    task gets a whole side."""
    of = lambda s, f, c: f(F.when(F.col("side") == s, F.col(c)))
    sizes = pairs.groupBy("pair_id").agg(*[(of(s, F.max, "win_idx") + 1).alias(f"n_{s}") for s in "ab"], *[of(s, F.avg, "rms").alias(f"mean_{s}") for s in "ab"]).where("n_a is not null and n_b is not null")
    places = sizes.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    own = lambda c: F.when(F.col("side") == "a", F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    places = places.select("pair_id", "side", "n_a", "n_b", own("mean").alias("mean"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((own("n") - 1) / segment))).alias("seg"))
    placed = pairs.select("pair_id", "side", F.floor(F.col("win_idx") / segment).alias("seg"), F.struct((F.col("win_idx") % segment).cast("int").alias("at"), F.col("rms").alias("v")).alias("x"))
    cut = placed.groupBy("pair_id", "side", "seg").agg(F.collect_list("x").alias("x")).join(places, ["pair_id", "side", "seg"])
    mean = F.col("mean") if center else F.lit(0.0)
    return cut.select("pair_id", "side", "seg", "n_a", "n_b", F.col("x.at").alias("at"), F.transform("x.v", lambda v: v - mean).alias("v"))


def _in_groups(batches, columns: list[str], keys: int):
    """Rows of columns, of sorted batches, in lists of those that agree in the first keys columns."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if group and group[0][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def cross_correlation(pairs: DataFrame, center: bool = True, segment: int = SEGMENT) -> DataFrame:
    """pair_id, lag, corr, overlap, n_min for every lag of envelopes (pair_id, side 'a' or 'b', win_idx, rms).

    lag is the place of b's first window in a.  Both envelopes are cut into segments, and each segment is transformed once.  Segments
    that lie equally far apart have the same lags between them, so for each frequency the products are a correlation along the
    segments' numbers, which a task takes by transforms of its own, for a few frequencies of all segments.  Those of one distance and of the
    next, which has the other half of the same lags, then come together and go back, for SEGMENT lags at once.  So what is sent
    grows with the envelopes and not with pairs of segments, and no task has a whole envelope.  A window that is missing counts
    as the mean.  A pair of which a side has no window gets one row without a lag.
    """
    size, count = 2 * segment, segment + 1
    kind = pairs.schema["pair_id"].dataType.simpleString()
    held = int(SHARE * 1024)

    def width_of(n_a: int, n_b: int) -> int:
        return max(1, min(count, held // (-(-n_a // segment) - (-n_b // segment))))

    def spectra(batches):
        for batch in batches:
            out: list[tuple] = []
            for pair, side, seg, n_a, n_b, at, v in zip(*[batch.column(c).to_pylist() for c in ("pair_id", "side", "seg", "n_a", "n_b", "at", "v")], strict=True):
                x = np.zeros(segment)
                x[np.asarray(at, dtype=int)] = v
                f, width = np.fft.rfft(x, size), width_of(n_a, n_b)
                out += [(pair, k // width, side, seg, n_a, n_b, f[k : k + width].tobytes()) for k in range(0, count, width)]
                if len(out) >= 1024:
                    yield arrow(batch.schema, out, ["pair_id", "band", "side", "seg", "n_a", "n_b", "f"])
                    out = []
            yield arrow(batch.schema, out, ["pair_id", "band", "side", "seg", "n_a", "n_b", "f"])

    def arrow(schema, rows, names):
        kinds = {"pair_id": schema.field("pair_id").type, "side": pa.string(), "f": pa.binary(), "corr": pa.float64()}
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)

    def along(batches):
        schema = None

        def seen():
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        for group in _in_groups(seen(), ["pair_id", "band", "side", "seg", "n_a", "n_b", "f"], 2):
            pair, band, _, _, n_a, n_b, first = group[0]
            segs = {"a": -(-n_a // segment), "b": -(-n_b // segment)}
            k = len(first) // 16
            sides = {s: np.zeros((n, k), dtype=complex) for s, n in segs.items()}
            for _, _, side, seg, _, _, f in group:
                sides[side][seg] = np.frombuffer(f, dtype=complex)
            m, n = segs["a"], segs["b"]
            met = np.fft.ifft(np.fft.fft(sides["a"], m + n, axis=0) * np.conj(np.fft.fft(sides["b"], m + n, axis=0)), axis=0)
            # by distance from -n to m, of which the first and last have no pairs
            apart = np.concatenate([np.zeros((1, k)), met[m + 1 :], met[:m], np.zeros((1, k))])
            turned = (-1.0) ** (band * width_of(n_a, n_b) + np.arange(k))
            both = apart[:-1] + turned * apart[1:]
            yield arrow(schema, [(pair, d, band, n_a, n_b, f.tobytes()) for d, f in zip(range(-n, m), both, strict=True)], ["pair_id", "distance", "band", "n_a", "n_b", "f"])

    def back(batches):
        schema = None

        def seen():
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield batch

        for group in _in_groups(seen(), ["pair_id", "distance", "band", "n_a", "n_b", "f"], 2):
            pair, distance, _, n_a, n_b, _ = group[0]
            corr = np.fft.irfft(np.frombuffer(b"".join(row[-1] for row in group), dtype=complex), size)[:segment]
            lag = distance * segment + np.arange(segment)
            usable = (lag > -n_b) & (lag < n_a)
            lag, corr = lag[usable], corr[usable]
            overlap = np.minimum(n_a, lag + n_b) - np.maximum(0, lag)
            columns = [pa.array([pair] * len(lag), schema.field("pair_id").type), *map(pa.array, (lag, corr, overlap, np.full(len(lag), min(n_a, n_b))))]
            yield pa.RecordBatch.from_arrays(columns, names=["pair_id", "lag", "corr", "overlap", "n_min"])

    f = _segments(pairs, center, segment).mapInArrow(spectra, f"pair_id {kind}, band long, side string, seg long, n_a long, n_b long, f binary")
    dealt = f.repartition("pair_id", "band").sortWithinPartitions("pair_id", "band", "side", "seg")
    met = dealt.mapInArrow(along, f"pair_id {kind}, distance long, band long, n_a long, n_b long, f binary")
    dealt = met.repartition("pair_id", "distance").sortWithinPartitions("pair_id", "distance", "band")
    found = dealt.mapInArrow(back, f"pair_id {kind}, lag long, corr double, overlap long, n_min long")
    alone = pairs.groupBy("pair_id").agg(*[F.max(F.col("side") == s).alias(s) for s in "ab"]).where("not (a and b)")
    return found.unionByName(alone.select("pair_id", F.lit(None).cast("long").alias("lag"), F.lit(None).cast("double").alias("corr"), F.lit(0).cast("long").alias("overlap"), F.lit(0).cast("long").alias("n_min")))


def offsets(correlation: DataFrame, window_seconds: float = WINDOW_SECONDS, rival_seconds: float = RIVAL_SECONDS, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """pair_id, offset_s, confidence, weak, error.

    The peak is the first greatest correlation among lags with enough overlap; confidence is the peak over the best
    usable lag further than rival_seconds from it, and 0 where there is no positive rival.  A pair that is too short to
    correlate has no offset, and says so in error, so it does not stop the others.
    """
    usable = correlation.where("lag is not null").where(F.col("overlap") >= min_overlap * F.col("n_min"))
    peak = usable.groupBy("pair_id").agg(F.min_by(F.struct("lag", "corr"), F.struct(-F.col("corr"), F.col("lag"))).alias("peak"))
    rivals = usable.join(F.broadcast(peak), "pair_id").where(F.abs(F.col("lag") - F.col("peak.lag")) > int(rival_seconds / window_seconds))
    rival = rivals.groupBy("pair_id").agg(F.max("corr").alias("rival"))
    confidence = F.when(F.col("rival") > 0, F.col("peak.corr") / F.col("rival")).otherwise(F.lit(0.0))
    out = peak.join(rival, "pair_id", "left").select("pair_id", (F.col("peak.lag") * window_seconds).alias("offset_s"), confidence.alias("confidence"))
    out = out.select("*", (F.col("confidence") < WEAK).alias("weak"), F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    short = correlation.where("lag is null").select("pair_id", none("double").alias("offset_s"), none("double").alias("confidence"), none("boolean").alias("weak"), F.lit("an envelope is too short to correlate").alias("error"))
    return out.unionByName(short)


def find_offset(envelopes: DataFrame, **options) -> DataFrame:
    """pair_id and offset_s; a pair that is too short to correlate is an error."""
    found = offsets(cross_correlation(envelopes), **options)
    return found.select("pair_id", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "pair_id", "error")).cast("double")).otherwise(F.col("offset_s")).alias("offset_s"))


def medians(values: DataFrame, limits: DataFrame, column: str) -> DataFrame:
    """pair_id, median of column of values, exactly; limits has least, most and n (how many are not null) of each pair.

    Values are counted by RANGES equal ranges; only the one or two ranges that hold the middle are ordered.
    """
    x, span = F.col(column), F.col("most") - F.col("least")
    at = F.when(span > 0, F.least(F.floor((x - F.col("least")) / span * RANGES), F.lit(RANGES - 1).cast("long"))).otherwise(F.lit(0).cast("long"))
    placed = values.where(x.isNotNull()).join(F.broadcast(limits.select("pair_id", "least", "most")), "pair_id").select("pair_id", x.alias("_x"), at.alias("_range"))
    counted = placed.groupBy("pair_id", "_range").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy("pair_id").orderBy("_range")) - F.col("_here")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_here"))
    middle = counted.withColumn("_before", before).join(F.broadcast(limits.select("pair_id", "n")), "pair_id").where(holds(low) | holds(high))
    near = placed.join(F.broadcast(middle.select("pair_id", "_range", "_before", "n")), ["pair_id", "_range"])
    same = near.groupBy("pair_id", "_range", "_x").agg(F.first("_before").alias("_first"), F.first("n").alias("n"), F.count("*").alias("_here"))
    same = same.withColumn("_before", F.col("_first") + F.sum("_here").over(Window.partitionBy("pair_id", "_range").orderBy("_x")) - F.col("_here"))
    ends = same.groupBy("pair_id").agg(*[F.max(F.when(holds(r), F.col("_x"))).alias(c) for r, c in ((low, "_low"), (high, "_high"))])
    return ends.select("pair_id", (0.5 * F.col("_low") + 0.5 * F.col("_high")).alias("median"))


def peak_metrics(correlation: DataFrame, window_seconds: float = WINDOW_SECONDS, rival_seconds: float = RIVAL_SECONDS) -> DataFrame:
    """pair_id, offset_s, peak_over_rival, peak_over_median, and least, greatest, median and deviation of the correlation.

    Over all lags, whatever their overlap; for the report on how far confidence can be trusted.
    """
    peak = correlation.groupBy("pair_id").agg(F.min_by("lag", F.struct(-F.col("corr"), F.col("lag"))).alias("lag0"), F.max("corr").alias("most"), F.min("corr").alias("least"), F.count("corr").alias("n"), F.stddev_pop("corr").alias("deviation"))
    far = correlation.join(F.broadcast(peak.select("pair_id", "lag0")), "pair_id").where(F.abs(F.col("lag") - F.col("lag0")) > int(rival_seconds / window_seconds)).groupBy("pair_id").agg(F.max("corr").alias("rival"))
    ratios = F.try_divide("most", "rival").alias("peak_over_rival"), F.try_divide("most", F.col("median")).alias("peak_over_median")
    all_of = peak.join(far, "pair_id", "left").join(medians(correlation, peak, "corr"), "pair_id", "left")
    return all_of.select("pair_id", (F.col("lag0") * window_seconds).alias("offset_s"), *ratios, "least", "most", "median", "deviation")


def unit_noise(k: Column, salt: int) -> Column:
    """A number between 0 and 1 that looks random, from a whole number under 2**30; plain arithmetic, so any engine can repeat it."""
    m = F.lit(1 << 32)
    x = (k.cast("long") * F.lit(2654435769) + F.lit(salt)) % m
    for shift in (15, 13):
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(1103515245) + F.lit(12345)) % m
    return (x.bitwiseXOR(F.shiftright(x, 16)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))


def add_null_controls(envelopes: DataFrame, seed: int = 7) -> DataFrame:
    """envelopes and, for each pair, controls that hold no alignment: unlike halves, b shuffled, b reversed, gaussian noise.

    Every window is read once and goes to its places in all controls.  Places in the shuffled order are counted by ranges of the
    noise that orders them, so no task orders or counts a whole side.
    """
    k, on = F.col("win_idx"), ["pair_id", "side"]
    sizes = envelopes.groupBy(*on).agg(F.count("*").alias("_n"), F.stddev_pop("rms").alias("_dev"), F.max("win_idx").alias("_last"))
    sizes = sizes.select(*on, "_n", "_dev", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / SEGMENT))).alias("_seg"))
    e = envelopes.withColumn("_seg", F.floor(k / SEGMENT)).join(sizes, [*on, "_seg"])
    e = e.withColumn("_u", unit_noise(k, seed)).withColumn("_range", F.floor(F.col("_u") * (F.floor(F.col("_n") / SEGMENT) + 1)))
    order = Window.partitionBy(*on, "_range")
    counted = e.groupBy(*on, "_range").agg(F.count("*").alias("_here"))
    counted = counted.select(*on, "_range", (F.sum("_here").over(Window.partitionBy(*on).orderBy("_range")) - F.col("_here")).alias("_before"))
    e = e.withColumn("_at", F.row_number().over(order.orderBy("_u", "win_idx")).cast("long") - 1).join(counted, [*on, "_range"])
    shuffled, half = F.col("_before") + F.col("_at"), F.floor(F.col("_n") / 2)
    gauss = F.sqrt(-2 * F.log(unit_noise(k, seed + 1))) * F.cos(2 * math.pi * unit_noise(k, seed + 2))
    noise = F.abs(gauss * F.col("_dev"))
    one = lambda kind, at=k, rms=F.col("rms"): F.struct(F.concat(F.col("pair_id").cast("string"), F.lit(kind)).alias("pair_id"), at.cast("long").alias("win_idx"), rms.alias("rms"))
    early, late = F.when(k < half, k), F.when(k >= half, k - half)
    halves = ("/first half, second half", "/second half, first half")
    a = F.array(one(""), one(halves[0], early), one(halves[1], late), one("/shuffled"), one("/reversed"), one("/noise"))
    b = F.array(one(""), one(halves[0], late), one(halves[1], early), one("/shuffled", shuffled), one("/reversed", F.col("_n") - 1 - k), one("/noise", rms=noise))
    cases = F.filter(F.when(F.col("side") == "a", a).otherwise(b), lambda x: x["win_idx"].isNotNull())
    others = [c for c in envelopes.columns if c not in ("pair_id", "win_idx", "rms")]
    return e.select(*others, F.explode(cases).alias("_case")).select(*others, "_case.*").select(envelopes.columns)


def control_report(envelopes: DataFrame) -> DataFrame:
    """peak_metrics() of each pair and of its controls, from means left in."""
    return peak_metrics(cross_correlation(add_null_controls(envelopes), center=False))


def separation(metrics: DataFrame) -> DataFrame:
    """Per pair: its own ratio, the least, median and greatest of its controls, how far they lie apart, and the middle."""
    parts = F.split("pair_id", "/", 2)
    m = metrics.select(parts[0].alias("pair_id"), (F.size(parts) > 1).alias("control"), F.col("peak_over_rival").alias("r"))
    of = lambda f: f(F.when(F.col("control"), F.col("r")))
    g = m.groupBy("pair_id").agg(F.max(F.when(~F.col("control"), F.col("r"))).alias("true"), of(F.min).alias("null_min"), F.percentile(F.when(F.col("control"), F.col("r")), F.lit(0.5)).alias("null_median"), of(F.max).alias("null_max"))
    return g.select("*", F.try_divide("true", F.col("null_max")).alias("separation"), ((F.col("true") + F.col("null_max")) / 2).alias("midpoint"))
