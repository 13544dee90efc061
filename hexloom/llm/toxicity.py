"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates over the words of a whole text: densities of a fixed and of a learned lexicon, second-person
proximity, capitals, punctuation and obfuscation. The learned lexicon holds stems (word starts) that nearly only
toxic training texts contain. Lexicon, trees and calibration are fitted on a sample of at most SAMPLE labelled rows,
those of the least hash of doc_id; scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import checkpointed, worker_memory

SAMPLE = 16_000
STEMS = 2000
STEM_SIZES = (4, 5, 6)
#: A stem is learned from this many toxic texts at least, which are this share of the texts that hold it.
STEM_TEXTS, STEM_SHARE = 6, 0.9
TREES, DEPTH = 12, 3
INSULTS = frozenset(
    "arschloch asshole bastard bitch blöd cabrón clown connard conne crap creep cretin crétin damn degenerate despicable "
    "disgusting dreck dumb dumm dummkopf estúpido feo filth filthy fool freak garbage hate hijo hure idiot idiota idiote "
    "imbecile imbécil imbécile jerk kill kotz loser maldito mierda miserable moron nasty pathetic pendejo pig pute puta "
    "rat repulsive salaud scheiße schwein scum shit sick stupid stupide trash trottel ugly verdammt vermin vile widerlich "
    "worthless wretched".split()
)
YOU = frozenset("you your yours yourself you're youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes tú ti tus su".split())
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_EDGE = ".,;:!?()[]{}\"'«»„“”|*#%&$-_…"
_CAPS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_PUNCT = re.compile(r"[!?.,;:…]")
_LOUD = re.compile(r"[!?]{2,}")
_HIDDEN = re.compile(r"[^\W\d_]+[0-9@$!*#]+[^\W\d_]")
FEATURES = ("insults", "stems", "different_stems", "hidden_insults", "you", "you_near_insult", "capitals", "shouting", "punctuation", "loud", "obfuscated", "log_words")


def features(text: str, stems: frozenset[str]) -> list[float]:
    """The FEATURES of one whole text; all 0 without words."""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(text.lower().split())
    insults = learned = you = 0
    different: set[str] = set()
    seen = {}
    for word, times in counts.items():
        bare = word.strip(_EDGE)
        if bare in INSULTS:
            insults += times
            seen[word] = True
        if bare in YOU:
            you += times
        hit = next((bare[:k] for k in STEM_SIZES if bare[:k] in stems), None) or (bare if bare in stems else None)
        if hit:
            learned += times
            different.add(hit)
            seen[word] = True
    hidden = 0
    found = _HIDDEN.findall(text)
    if found:
        hidden = sum((w := c.translate(_PLAIN).strip(_EDGE)) in INSULTS or w[:5] in stems for c in counts if _HIDDEN.search(c))
    near = 0
    if you and seen:
        low = text.lower().split()
        at = [i for i, w in enumerate(low) if w in seen]
        near = sum(any(w.strip(_EDGE) in YOU for w in low[max(0, i - 4) : i + 5]) for i in at)
    size = len(text)
    rate = 100.0 / n
    return [
        insults * rate, learned * rate, float(np.log1p(len(different))), float(hidden), you * rate, near * rate,
        len(_CAPS.findall(text)) / size, len(_SHOUT.findall(text)) * rate, len(_PUNCT.findall(text)) / size,
        len(_LOUD.findall(text)) * rate, len(found) * rate, float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, stems: frozenset[str]) -> DataFrame:
    """docs (with text) and dense: the features of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(stems)  # STEMS entries at most

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        worker_memory("toxicity")
        return pd.Series([features(t, shared.value) for t in texts])

    return docs.withColumn("dense", dense(F.coalesce("text", F.lit(""))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, label of at most sample labelled rows outside the held-out fifth, each text once."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    marked = marked.where(~held_out("doc_id"))
    chosen = checkpointed(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("sig")).agg(F.first("text").alias("text"), F.max("label").alias("label"))


def held_out(column: str) -> F.Column:
    """Whether the remainder of crc32 of the id as text by five is zero; a null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_stems(rows: DataFrame, limit: int = STEMS) -> frozenset[str]:
    """Word starts and words in at least STEM_TEXTS toxic texts that are STEM_SHARE of all texts with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory("toxicity")
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                found = set()
                for word in {w.strip(_EDGE) for w in text.lower().split()}:
                    found.update(word[:k] for k in STEM_SIZES if len(word) >= k)
                    if len(word) > 2:
                        found.add(word)
                (toxic if label else clean).update(found)
        stems = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({"stem": pd.Series(stems, dtype=object), "toxic": [toxic[s] for s in stems], "clean": [clean[s] for s in stems]}).astype({"toxic": "int64", "clean": "int64"})

    counted = rows.select("text", "label").mapInPandas(run, "stem string, toxic long, clean long")
    counted = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counted.where((F.col("toxic") >= STEM_TEXTS) & (F.col("toxic") >= STEM_SHARE * (F.col("toxic") + F.col("clean"))))
    return frozenset(r["stem"] for r in good.orderBy(F.desc("toxic"), "clean", "stem").limit(limit).collect())


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), learned from labels (doc_id, toxic).

    score is a calibrated probability in [0, 1]; predicted is 1 from 0.5 on. Null and empty texts have features 0 and
    a score like any other; a null doc_id is held out. Of a doc_id labelled repeatedly the highest label counts, and
    equal texts are one training row. Without training rows of both labels every score is 0. Repeated rows come out
    repeated; other columns are not read.
    """
    scored = with_scores(docs, labels, sample, F.col("doc_id"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, labels: DataFrame, sample: int, kept: F.Column) -> DataFrame:
    """The column kept and score for every row of docs. Rows are scored where they are read, so kept is never shuffled."""
    rows = checkpointed(training_rows(docs, labels, sample).repartition(8, "sig"))
    kinds = rows.select("label").distinct().collect()
    if len(kinds) < 2:
        return docs.select(kept, F.lit(0.0).alias("score"))
    stems = learn_stems(rows)
    # merged before the features: a merged task would keep the buffered rows of each of its partitions to its end
    few = rows.coalesce(4)
    train = checkpointed(with_features(few, stems).select("sig", "label", array_to_vector("dense").alias("features")))
    # trees and calibration from different rows, so that the calibration isn't fooled by fitted scores
    parts = [train.where(F.pmod("sig", F.lit(4)) != 0), train.where(F.pmod("sig", F.lit(4)) == 0)]
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, seed=7, subsamplingRate=1.0, cacheNodeIds=False).fit(parts[0])
    raw = vector_to_array("probability")[1].alias("raw")
    steps = IsotonicRegression(featuresCol="raw", predictionCol="score").fit(trees.transform(parts[1]).select("label", raw))
    edges, values = ([float(x) for x in v.toArray()] for v in (steps.boundaries, steps.predictions))
    texts = docs.select(kept, "text")
    name = texts.columns[0]
    out = trees.transform(with_features(texts, stems).select(name, array_to_vector("dense").alias("features"))).select(name, raw)
    return out.select(name, calibrated(F.col("raw"), edges, values).alias("score"))


def calibrated(raw: F.Column, edges: list[float], values: list[float]) -> F.Column:
    """The isotonic step function, linear between its boundaries."""
    if not edges:
        return raw
    out = F.lit(values[-1])
    for (a, b), (u, v) in reversed(list(zip(zip(edges, edges[1:]), zip(values, values[1:])))):
        between = F.lit(u) if u == v or a == b else F.lit(u) + (raw - a) * ((v - u) / (b - a))
        out = F.when(raw < b, between).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(raw < edges[0], values[0]).otherwise(out)))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, each judged by its own text, as its doc_id may be null or repeated."""
    scored = with_scores(docs, labels, SAMPLE, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return scored.where("score < 0.5").select("row.*")
