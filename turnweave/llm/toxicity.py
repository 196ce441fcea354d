"""Operator 10: weighted toxicity lexicon.

A text is folded (compatibility forms, accents, look-alike letters of other scripts, digits and signs that stand
for letters) and cut into words.  One Aho-Corasick automaton holds the lexicon and the exception phrases: words of the
built-in lexicon as whole words with the endings of ENDINGS, stems learnt from labels at the start of a word; a hit inside an exception phrase does not count.  The weights of the hits, as they
are and divided by the number of words, go through a logistic curve.

Stems and weights are learnt from labelled texts of the training fold: the log odds of a word start in toxic
against other texts.  A built-in lexicon serves words that the labels do not show: where MIN_DOCS texts hold one of its
stems, the labels decide its weight, and one that is no sign of toxicity there is left out.  The fit reads at most
FIT_ROWS labelled rows, those with the smallest hash of their doc_id; words are learnt from at most FIT_CHARS characters of
each, spread over the whole text, and the curve is fitted on whole texts.  Scores are given to every row; labels,
language, source and doc_id never enter a score.

Defined results: a null or empty text has no hits and the score of a clean text; null labels, and ids with labels that
contradict one another, are not learnt from; of a labelled id with several texts the least text is learnt from; repeated
rows get equal scores; without labels the built-in weights and curve hold.  An empty table gives an empty result.  Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, portions, table
from .quality import excerpts, fit_logistic, fold, labelled_sample, measured, score_documents

FIT_ROWS, FIT_CHARS, THRESHOLD = 6000, 16_384, 0.7
#: Word starts of MIN_STEM to MAX_STEM letters are candidates; MIN_DOCS toxic texts, as many different words before it
#: (copies of one text count once) and log odds of MIN_ODDS admit one.
MIN_STEM, MAX_STEM, MIN_DOCS, MIN_ODDS = 4, 12, 6, 3.0
#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
LOOK_ALIKES = str.maketrans(
    "авекмнорстухіјѕԁɡһӏԛԝαβεικνορτυχ" + "013457",
    "abekmhopctyxijsdghlqwabeiknoptux" + "oieast",
)
#: Signs that stand for letters between two letters.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
SIGN = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
NOT_WORD = re.compile(r"[\W_]+")
#: Stems of insults and threats, by how sure a sign they are; the labels, where they show a stem, replace its weight.
ENDINGS = ("", "s", "es", "ed", "er", "ers", "ing", "y")
BUILT_IN = dict.fromkeys(
    "idiot moron imbecile stupid pathetic worthless disgusting scumbag dumbass asshole bastard bitch dickhead douche shithead "
    "retard retarded motherfuck motherfucker motherfuckers".split() + ["shut up", "kill yourself", "go to hell", "piece of shit", "fuck you", "drop dead"], 4.0
) | dict.fromkeys("scum trash vermin filth loser jerk creep coward crap fuck shit cretin dimwit halfwit nitwit lowlife".split(), 3.0
) | dict.fromkeys("fool clown freak dumb ugly liar hate".split(), 1.5)
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "take out the trash", "clown fish", "clownfish", "circus clown", "rodeo clown",
    "pond scum", "soap scum", "april fool", "april fools", "fool s gold", "foolproof", "fool proof", "control freak", "freak accident", "freak wave",
    "dumbbell", "dumbbells", "dumb waiter", "dumbwaiter", "dumbfounded", "ugly duckling", "sore loser", "hate to say", "hate speech", "creeper", "creeping", "jerking", "jerked", "jerky", "trashed",
)


def folded(text: str) -> str:
    """Folded words, each with one space before it, and one space at the end."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    if SIGN.search(text):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return " " + NOT_WORD.sub(" ", text.translate(LOOK_ALIKES)).strip() + " "


def whole_words(words: dict[str, float]) -> dict[str, float]:
    """Every word between spaces, with every ending; the larger weight of equal forms."""
    out: dict[str, float] = {}
    for w, weight in words.items():
        for form in {f" {w}{e} " for e in ENDINGS} | {f" {w}{w[-1]}{e} " for e in ENDINGS if e[:1] in ("e", "i", "y")}:
            out[form] = max(weight, out.get(form, 0.0))
    return out


class ToxicityModel:
    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, words: dict[str, float] | None = None):
        """weights: of stems at the start of a word; words: of whole words, which also count with an ending."""
        self.weights, self.exceptions, self.words = weights, tuple(exceptions), words or {}
        # one sure insult (4.0) among few words is over the threshold, a weak one (1.5) is not
        self.curve = (np.array([1.0, 0.5]), -2.8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _compile(self):
        a = ahocorasick.Automaton()
        for stem, w in self.weights.items():
            a.add_word(" " + stem, (len(stem) + 1, w))
        for form, w in whole_words(self.words).items():
            a.add_word(form, (len(form), w))
        for phrase in self.exceptions:
            a.add_word(folded(phrase), (len(folded(phrase)), 0.0))
        a.make_automaton()
        self._automaton = a

    def hits(self, text: str) -> tuple[float, int]:
        """Sum of the weights of all hits outside exception phrases, at most one for each word; number of words."""
        if not hasattr(self, "_automaton"):
            self._compile()
        body = folded(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self._automaton):
            for end, (n, w) in self._automaton.iter(body):
                start = end + 1 - n
                if w:
                    best[start] = max(w, best.get(start, 0.0))
                else:
                    spared.append((start, end))
        total, reach, at = 0.0, -1, 0
        spared.sort()
        for start in sorted(best):  # both are in order: each exception is looked at once
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if start >= reach:
                total += best[start]
        return total, body.count(" ") - 1 if len(body) > 2 else 0

    def inputs(self, text: str) -> np.ndarray:
        total, words = self.hits(text)
        return np.array([math.log1p(total), math.log1p(1000 * total / (words + 50))])

    def score(self, text: str | None) -> float:
        w, bias = self.curve
        z = float(np.dot(self.inputs(text or ""), w)) + bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def starts_of(word: str) -> list[str]:
    return [word[:n] for n in range(MIN_STEM, min(len(word), MAX_STEM) + 1)]


def learn_weights(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Log odds of word starts.  A start is left out where a shorter one that is kept says as much."""
    n1, n0 = (sum(y == k for _, y in rows) for k in (1, 0))
    if not n0 or not n1:
        return {}
    toxic: Counter = Counter()
    for text, y in rows:
        if y:
            toxic.update({s for w in set(folded(text).split()) for s in starts_of(w)})
    often = {s: [c, 0, set()] for s, c in toxic.items() if c >= MIN_DOCS}
    for text, y in rows:
        words = folded(text).split()
        if y:
            for before, word in zip(["", *words], words, strict=False):
                for s in starts_of(word):
                    if s in often and len(often[s][2]) < MIN_DOCS:
                        often[s][2].add(before)
        else:
            for s in {s for w in set(words) for s in starts_of(w)} & often.keys():
                often[s][1] += 1
    odds = {}
    for stem, (c1, c0, befores) in often.items():
        w = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
        if w >= MIN_ODDS and len(befores) >= MIN_DOCS:
            odds[stem] = w
    kept: dict[str, float] = {}
    for stem in sorted(odds, key=lambda s: (len(s), s)):
        shorter = [kept[stem[:n]] for n in range(MIN_STEM, len(stem)) if stem[:n] in kept]
        if not shorter or odds[stem] > max(shorter) + 1.0:
            kept[stem] = odds[stem]
    return kept


def built_in_weights(rows: list[tuple[str, int]]) -> dict[str, float]:
    """The built-in stems that rows do not contradict; where MIN_DOCS rows hold one, its weight is their log odds."""
    n1, n0 = (sum(y == k for _, y in rows) for k in (1, 0))
    stems = {folded(w).strip(): weight for w, weight in BUILT_IN.items()}
    seen = {s: [0, 0] for s in stems}
    search = ahocorasick.Automaton()
    for s in stems:
        for form in whole_words({s: 1.0}):
            search.add_word(form, s)
    search.make_automaton()
    for text, y in rows:
        for s in {s for _, s in search.iter(folded(text))}:
            seen[s][y] += 1
    out = {}
    for s, weight in stems.items():
        c0, c1 = seen[s]
        if c0 + c1 >= MIN_DOCS:
            weight = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
        if weight > 0:
            out[s] = weight
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Weights from two thirds of the rows, the curve from the rest, so that chance words do not sharpen it."""
    sample = labelled_sample(docs, labels, "toxic", fit_rows)
    third = F.pmod(F.xxhash64("text"), F.lit(3))
    known = [(t, y) for _, t, y in excerpts(sample.where(third != 0), FIT_CHARS)]
    model = ToxicityModel(learn_weights(known), words=built_in_weights(known))
    x, y = measured(sample.where(third == 0), model, 2)
    if len(set(y.tolist())) == 2:
        model.curve = fit_logistic(x, y, ridge=0.1)
    forget(sample)
    return model


def training_fold(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 3) != 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, train_toxicity(docs, training_fold(labels)))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_below(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores below threshold; no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in portions(batches):
            scores = [m.score(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
