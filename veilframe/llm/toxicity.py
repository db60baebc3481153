"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import id_remainder, unit_hash
from .shared import STEP_BYTES, by_bytes, kept, own_names, text_of, texts

#: About how many labelled rows of each label the model is learned from.
MAX_FIT_ROWS = 20_000
#: Least documents with a term, toxic ones among them by odds, for it to enter the lexicon; characters of a stem.
MIN_DOCS, MIN_LOG_ODDS, STEMS = 6, 3.0, (4, 5, 6)

#: Second-person words of the languages at hand, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself ur u thou thee thy tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr sie usted ustedes vosotros tú ti tuyo su".split())
LOOKALIKES = str.maketrans("013457@$!|+", "oieastasiit")

MARKS = ".,;:!?\"'()[]{}«»“”‘’¡¿*_-~…"
FEATURES = ["words", "word_hits", "word_density", "word_kinds", "stem_hits", "stem_density", "stem_kinds", "near_second", "densest", "capitals", "shouted", "marks", "exclaims", "obfuscated", "hidden_hits", "stretched"]

_mixed = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W\d_][0-9@$!|*+.\-_]+[^\W\d_]\S*")
_stretched = re.compile(r"([^\W\d_])\1\1")


def terms_of(text: str) -> tuple[set[str], set[str]]:
    """The text's distinct words, lower-cased and without marks at their ends, and the stems of longer ones."""
    words = {w.strip(MARKS) for w in set(text.lower().split())}
    return words, {w[:n] for w in words if len(w) > 5 for n in STEMS if len(w) > n}


def features_of(text: str, words_lex: frozenset[str], stems_lex: frozenset[str]) -> list[float]:
    """The features named in FEATURES, over the whole text."""
    raw = text.split()
    n = len(raw)
    low = [w.strip(MARKS) for w in text.lower().split()]
    kinds: dict[str, int] = {}
    for word, times in Counter(low).items():
        hit = 1 if word in words_lex else 0
        if len(word) > 5 and any(word[:k] in stems_lex for k in STEMS if len(word) > k):
            hit |= 2
        if hit:
            kinds[word] = hit
    at = [i for i, w in enumerate(low) if w in kinds] if kinds else []
    words = [low[i] for i in at if kinds[low[i]] & 1]
    stems = [low[i] for i in at if kinds[low[i]] & 2]
    near = sum(any(w in SECOND_PERSON for w in low[max(0, i - 4) : i + 5]) for i in at)
    densest = max((sum(1 for j in at[k : k + 50] if j < i + 50) for k, i in enumerate(at)), default=0)
    letters = max(1, len(text))
    mixed = _mixed.findall(text) if any(c in text for c in "0134579@$!|*+_-") else []
    hidden = 0
    for token in mixed:
        plain = re.sub(r"[^\w]|_", "", token.lower().translate(LOOKALIKES))
        hidden += plain in words_lex or any(plain[:k] in stems_lex for k in STEMS if len(plain) > max(5, k))
    per = 100 / max(1, n)
    return [
        float(n), float(len(words)), len(words) * per, float(len(set(words))), float(len(stems)), len(stems) * per, float(len(set(stems))),
        near * per, float(densest), sum(map(str.isupper, text)) / letters, sum(w.isupper() and len(w) > 1 for w in raw) * per,
        sum(map(text.count, MARKS)) / letters, text.count("!") * per, len(mixed) * per, float(hidden), len(_stretched.findall(text)) * per,
    ]


def learn_lexicon(labelled: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems that go with label 1, from rows (body, label): counted by Spark; as many as the labelled rows bear out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in by_bytes(b, 0, STEP_BYTES)):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words, stems = terms_of(text)
                counts[label].update(("w", w) for w in words if w)
                counts[label].update(("s", s) for s in stems)
            terms = list(counts[0] | counts[1])
            yield pa.record_batch([pa.array([t[0] for t in terms], pa.string()), pa.array([t[1] for t in terms], pa.string()), *(pa.array([counts[i][t] for t in terms], pa.int64()) for i in (0, 1))], ["kind", "term", "clean", "toxic"])

    totals = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    counts = labelled.mapInArrow(count, "kind string, term string, clean long, toxic long").groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (totals.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (totals.get(0, 0) + 1))
    chosen = counts.filter(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
    found = [(r["kind"], r["term"]) for r in chosen.select("kind", "term").collect()]
    return tuple(frozenset(term for k, term in found if k == kind) for kind in "ws")


def with_features(rows: DataFrame, lexicon: tuple[frozenset[str], frozenset[str]]) -> DataFrame:
    """rows (body, then others) with one double for each of FEATURES in place of body."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = shared.value
        for batch in (p for b in batches for p in by_bytes(b, 0, STEP_BYTES)):
            values = [features_of(t, words, stems) for t in texts(batch.column(0))]
            yield pa.record_batch([*batch.columns[1:], *(pa.array([v[i] for v in values], pa.float64()) for i in range(len(FEATURES)))], [*batch.schema.names[1:], *FEATURES])

    others = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(compute, ", ".join([*others, *(f"{n} double" for n in FEATURES)]))


@own_names
def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learned from labels (doc_id, toxic) whose id's remainder modulo 5 is not 0 (held_out: it is), about MAX_FIT_ROWS of
    each label, chosen and dealt to three folds by a hash of the id: one gives the lexicon, one the trees, one the
    isotonic calibration, so that no step sees rows that the one before it fitted. Where a label is thinned, its rows
    weigh as much more in trees and calibration. Labels that are null, other than 0 and 1 or
    repeated with different values teach nothing. Without examples of both labels every score is the share of label 1,
    or 0. Null and empty texts have zero features and a score like any other; rows with a null or repeated doc_id are
    documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(text_of().alias("body"), "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"))
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").alias("other"))
    usable = usable.filter((F.col("label") == F.col("other")) & (id_remainder("doc_id", 5) != 0)).select("doc_id", "label")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, MAX_FIT_ROWS / counts.get(1, 1)))).otherwise(F.lit(min(1.0, MAX_FIT_ROWS / counts.get(0, 1))))
    usable = usable.withColumn("weight", 1 / share).filter(unit_hash(F.col("doc_id"), 3) < share)
    fold = F.when(F.col("h") < 5, 0).when(F.col("h") < 8, 1).otherwise(2)
    fit = usable.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)))
    # a sample of bounded size: at most about two labels' rows of 40 bytes
    rows = kept(docs.select(text_of().alias("body"), "doc_id").join(F.broadcast(fit), "doc_id").select("body", "label", "weight", fold.alias("fold")))
    lexicon = learn_lexicon(rows.filter("fold = 0").select("body", "label"))
    known = kept(with_features(rows.filter("fold > 0"), lexicon))
    by_label = {(r["fold"], r["label"]): r["sum(weight)"] for r in known.groupBy("fold", "label").sum("weight").collect()}
    scored = with_features(source, lexicon)
    if any(not by_label.get((1, k)) for k in (0, 1)):
        total = sum(by_label.values())
        share = sum(v for (_, k), v in by_label.items() if k) / total if total else 0.0
        return scored.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=4, maxBins=64, stepSize=0.2, seed=5).fit(assemble.transform(known.filter("fold = 1")))
    margin = vector_to_array("probability")[1]

    def raw(df: DataFrame) -> DataFrame:
        return trees.transform(assemble.transform(df)).withColumn("margin", margin)

    iso_rows = raw(known.filter("fold = 2")).select("margin", "weight", F.col("label").cast("double").alias("label"))
    if all(by_label.get((2, k)) for k in (0, 1)):
        iso = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(iso_rows)
        out = iso.setPredictionCol("calibrated").transform(raw(scored))
        # isotonic steps are flat: a little of the trees' own probability keeps the order within a step
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("calibrated") + 0.02 * F.col("margin")))
    else:
        out, score = raw(scored), F.col("margin")
    return out.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
