"""Toxic documents by a convolutional text classifier, trained in numpy.

Text. ASCII lower case, punctuation to spaces, words between white space. A word is the sum of the hashed embeddings of itself and
of its beginnings, so that other forms of a word share what is learned. Filters of widths 1 to 3 run over whole texts, their maxima over the text feed a
logistic layer. For scoring, the product of each table with each filter is made once in a worker; a filter is then a sum of look-ups.

Labels. Fitting takes at most POSITIVES and NEGATIVES labelled documents (a bounded sample in hash order of the ids, documented
parameters, as is BYTES of their words; all where there are fewer) of three quarters of those the caller allows. One task of an executor trains; the driver gets the model. Thresholds: a text's
language is guessed from its own function words (the lang column is never read). All documents are scored in the executors; the allowed labelled
ones that fitting did not see are counted by language and score, each class weighted to its true share of all allowed labels. So the thresholds
don't depend on the bounds of the sample. The best threshold of each language is drawn towards the common one where there are few labels, and
scores are bent so that it lies at `cut`.

Null text is empty text, and has a score as any other. Null ids are kept, and are held out of nothing; labels with nulls are left out,
of several labels for an id the largest holds. Without both labels in the sample every score is 0. Repeated rows are all
scored. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import Scratch, byte_slices, fresh, frugal, frugal_group

#: Bounds of the labelled sample: documents of each label, and bytes of hashed words of each label (20 a word); the hash tables' rows, embedding and filters of each width; documents a step, steps, rates.
POSITIVES, NEGATIVES, BYTES = 3_000, 6_000, 128 << 20
#: Documents of the fitting sample that a word has to be in; others say nothing.
LEAST_DOCS = 8
ROWS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Bytes of the beginnings of a word that have embeddings of their own.
BEGINNINGS = (4, 5, 6, 7)
KINDS = 1 + len(BEGINNINGS)
BATCH, STEPS, RATE = 64, 800, 0.05
SLICE = 512 << 10
#: Thresholds that are tried, close to each other near 0 and 1, as scores before the bend crowd there.
GRID = 1 / (1 + np.exp(-np.linspace(-8, 8, 161)))
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was are this",
    "fr": "le la les des et que un une est dans pour sur",
    "de": "der die das und ist nicht ein eine den von mit zu",
    "es": "el los las que en por con una para del se su",
}
LANGUAGES = ("", *FUNCTION_WORDS)
GUESS = {zlib.crc32(w.encode()): k for k, lang in enumerate(LANGUAGES[1:], 1) for w in FUNCTION_WORDS[lang].split()}


def hashed(raw: bytes) -> np.ndarray:
    """CRC-32 of each word and of its beginnings (0: the word is shorter), a row for a word, and two marks of the end."""
    found = raw.lower().translate(PUNCTUATION).split()
    out = np.zeros((len(found) + 2, KINDS), np.uint32)
    if not found:
        return out
    distinct = list(dict.fromkeys(found))
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    table = np.zeros((len(distinct), KINDS), np.uint32)
    table[:, 0] = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    for k, n in enumerate(BEGINNINGS, 1):
        table[:, k] = [zlib.crc32(w[:n], k) if len(w) >= n else 0 for w in distinct]
    out[:-2] = table[[place[w] for w in found]]
    return out


def language(words: np.ndarray) -> int:
    """Place in LANGUAGES of the language whose function words are most frequent; 0 if none is there."""
    words = words[:, 0]
    hits = np.zeros(len(LANGUAGES), np.int64)
    keys = np.fromiter(GUESS, np.uint32)
    kinds = np.fromiter(GUESS.values(), np.int64)
    order = np.argsort(keys)
    keys, kinds = keys[order], kinds[order]
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    np.add.at(hits, kinds[at[keys[at] == words]], 1)
    hits[0] = 0
    return int(hits.argmax())


def frequent(docs: list[np.ndarray], least: int = LEAST_DOCS) -> np.ndarray:
    """Sorted hashes of the words in at least `least` documents."""
    words, count = np.zeros(0, np.uint32), np.zeros(0, np.int32)
    for at in range(0, len(docs), 500):  # merged in parts, to hold little at once
        own, n = np.unique(np.concatenate([np.unique(d) for d in docs[at : at + 500]]), return_counts=True)
        words, back = np.unique(np.concatenate([words, own]), return_inverse=True)
        count = np.bincount(back, np.concatenate([count, n]), len(words)).astype(np.int32)
    return words[(count >= least) & (words != 0)]


def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows in the table; row ROWS is for the mark of the end and for what is not known."""
    rows = (words & np.uint32(ROWS - 1)).astype(np.int32)
    rows[known[np.minimum(np.searchsorted(known, words), len(known) - 1)] != words if len(known) else ...] = ROWS
    return rows


class Model:
    """An embedding table, filters by width, a logistic layer, and the bend of the scores of each language."""

    def __init__(self, seed: int = 7):
        make = np.random.default_rng(seed)
        self.table = make.normal(0, 0.05, (ROWS + 1, DIM)).astype(np.float32)
        self.table[ROWS] = 0
        self.filters = [make.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.out = make.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(-1)
        self.bend = np.full(len(LANGUAGES), 0.5)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """Adagrad over balanced batches; only the words at each filter's maximum get a gradient."""
        self.known = frequent(docs)
        make = np.random.default_rng(3)
        params = [self.table, *self.filters, self.bias, self.out]
        sums = [np.full(p.shape, 1e-4, np.float32) for p in params]
        base_sum = 1e-4
        sides = [np.flatnonzero(labels == k) for k in (0, 1)]
        for step in range(STEPS):
            rate = RATE * (1 - step / STEPS) + 1e-3
            who = np.concatenate([make.choice(s, BATCH // 2) for s in sides])
            ends = np.cumsum([len(docs[i]) for i in who])
            starts = np.concatenate([[0], ends[:-1]])
            rows_of = places(np.concatenate([docs[i] for i in who]), self.known)
            x = self.table[rows_of].sum(1)
            best, top = [], []
            for k, w in enumerate(WIDTHS):
                a = x @ self.filters[k][0]
                for j in range(1, w):
                    a[:-j] += x[j:] @ self.filters[k][j]
                at = np.stack([s + a[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
                best.append(at)
                top.append(np.take_along_axis(a, at, 0))
            raw = np.concatenate(top, 1) + self.bias
            feature = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(feature @ self.out + self.base)))
            error = ((p - labels[who]) / len(who)).astype(np.float32)
            down = error[:, None] * self.out * (raw > 0)
            grads = [np.zeros_like(f) for f in self.filters]
            rows: list[np.ndarray] = []
            steps: list[np.ndarray] = []
            for k, w in enumerate(WIDTHS):
                g = down[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at = np.minimum(best[k] + j, len(x) - 1)
                    grads[k][j] = np.einsum("nfd,nf->df", x[at], g)
                    rows.append(at.ravel())
                    steps.append((g[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIM))
            at, grad = np.concatenate(rows), np.concatenate(steps)
            used = np.abs(grad).sum(1) > 0
            own, back = np.unique(rows_of[at[used]], return_inverse=True)
            total = np.zeros((len(own), DIM), np.float32)
            np.add.at(total, back.ravel(), np.repeat(grad[used], KINDS, 0))
            total[own == ROWS] = 0
            sums[0][own] += total**2
            self.table[own] -= rate * total / np.sqrt(sums[0][own])
            for n, g in enumerate([*grads, down.sum(0), feature.T @ error], 1):
                g = g + 1e-4 * params[n]
                sums[n] += g**2
                params[n] -= rate * g / np.sqrt(sums[n])
            base_sum += float(error.sum()) ** 2
            self.base -= np.float32(rate * error.sum() / np.sqrt(base_sum))

    def raw_scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Before the bend, of each document."""
        if not docs:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        rows = places(np.concatenate(docs), self.known)
        features = []
        for k, w in enumerate(WIDTHS):
            a = None
            for j in range(w):
                looked = self.looked_up()[k][j]
                part = looked[rows[:, 0]]
                for kind in range(1, KINDS):
                    part += looked[rows[:, kind]]
                if a is None:
                    a = part
                else:
                    a[:-j] += part[j:]
            features.append(np.maximum.reduceat(a, starts, axis=0))
        feature = np.maximum(np.concatenate(features, 1) + self.bias, 0)
        return 1 / (1 + np.exp(-(feature @ self.out + self.base).astype(np.float64)))

    def looked_up(self) -> list[list[np.ndarray]]:
        if not hasattr(self, "products"):
            self.products = [[self.table @ f[j] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        return self.products

    def calibrate(self, counts: np.ndarray) -> None:
        """The threshold with the fewest errors, for all and by language; a clean document lost counts twice.

        counts: labelled documents by language, toxic, seen in fitting, and thresholds at or below the score.
        """
        every, own = counts.sum((0, 2, 3)), counts[:, :, 0].astype(float)
        unseen = own.sum((0, 2))
        if unseen.all():
            own *= (every / unseen * unseen.sum() / every.sum())[None, :, None]
        else:
            own = counts.sum(2).astype(float)

        def wrong(by: np.ndarray) -> np.ndarray:
            return 2 * (by[0].sum() - np.cumsum(by[0])[:-1]) + np.cumsum(by[1])[:-1]

        def middle(costs: np.ndarray) -> float:
            return float(np.median(GRID[costs <= costs.min() + 1e-9]))

        common = wrong(own.sum(0))
        self.bend[:] = middle(common)
        for k in range(1, len(LANGUAGES)):
            if own[k].sum(1).all():
                self.bend[k] = middle(wrong(own[k]) + common * 20 / own.sum())


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, words): hashed words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(x.as_py()).tobytes() for x in pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.binary())], ["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, words binary")


def allowed(labels: DataFrame, seen: str) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from, one row an id."""
    return labels.filter(f"doc_id is not null and toxic in (0, 1) and ({seen})").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def chosen(sizes: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(doc_id, toxic) of as many of sizes(doc_id, toxic, bytes), in their order, as fit in BYTES for each label; the first one of a label always does."""
    out, held = [], [0, 0]
    for i, toxic, size in sizes:
        if held[toxic] and held[toxic] + size > BYTES:
            continue
        held[toxic] += size
        out.append((i, toxic))
    return out


def fit(docs: DataFrame, known: DataFrame, scratch: Scratch) -> tuple[Model | None, list[int]]:
    """The model of known(doc_id, toxic), not calibrated, and the ids it was fitted to; None without both labels.

    The sample's words go to one task of an executor, which trains; only ids, sizes and the model come to the driver.
    """
    order = [F.xxhash64("doc_id"), "doc_id"]
    unseen = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string"))) % 4 == 0
    spark = docs.sparkSession
    for rows in (known.filter(~unseen), known):  # all of them only where three quarters lack a label
        sample = {r[0]: r[1] for k, n in ((1, POSITIVES), (0, NEGATIVES)) for r in rows.filter(F.col("toxic") == k).orderBy(*order).limit(n).collect()}
        ids = spark.createDataFrame([(i, int(t), n) for n, (i, t) in enumerate(sample.items())], "doc_id long, toxic int, place int")
        found = scratch.keep(words_of(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")))
        sizes = found.groupBy("doc_id").agg(F.max(F.octet_length("words")).alias("size")).join(F.broadcast(ids), "doc_id").orderBy("place").select("doc_id", "toxic", "size").collect()
        own = chosen([tuple(r) for r in sizes])
        if len({t for _, t in own}) == 2:
            break
        scratch.drop(found)
    else:
        return None, []
    told = spark.createDataFrame(own, "doc_id long, toxic int")

    def train(group: pa.Table) -> pa.Table:
        by_id = dict(zip(group.column("doc_id").to_pylist(), zip(group.column("words"), group.column("toxic").to_pylist(), strict=True), strict=True))
        order_ = sorted(by_id)
        words = [np.frombuffer(by_id[i][0].as_buffer(), np.uint32).reshape(-1, KINDS) for i in order_]
        model = Model()
        model.fit(words, np.array([by_id[i][1] for i in order_], np.float32))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = found.join(F.broadcast(told), "doc_id").groupBy(F.lit(0).alias("all")).applyInArrow(frugal_group(train), "model binary").first()
    scratch.drop(found)
    return pickle.loads(made[0]), [i for i, _ in own]


def scored(fitted: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score before the bend and language of each text of a batch."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    raw, kinds = [np.zeros(0)], [np.zeros(0, np.int32)]
    for a, b in byte_slices(pc.binary_length(texts).to_numpy(), SLICE):
        words = [hashed(x) for x in texts.slice(a, b - a).to_pylist()]
        raw.append(fitted.raw_scores(words))
        kinds.append(np.array([language(w) for w in words], np.int32))
    return np.concatenate(raw), np.concatenate(kinds)


def calibrated(model: Model, rows: DataFrame, names: tuple[str, str], known: DataFrame, fitted: list[int]) -> None:
    """Sets the thresholds from rows(doc_id and names: score before the bend, language) of all documents."""
    raw, kind = names
    ids = rows.sparkSession.createDataFrame([(i, 1) for i in fitted], "doc_id long, seen int")
    steps = F.array(*[F.lit(float(t)) for t in GRID])
    place = F.size(F.filter(steps, lambda t: t <= F.col(raw)))
    of = rows.select("doc_id", F.col(kind).alias("kind"), place.alias("place")).join(known, "doc_id").join(F.broadcast(ids), "doc_id", "left")
    counts = np.zeros((len(LANGUAGES), 2, 2, len(GRID) + 1), np.int64)
    for r in of.groupBy("kind", "toxic", F.coalesce("seen", F.lit(0)), "place").count().collect():
        counts[tuple(r[:4])] = r[4]
    model.calibrate(counts)


def classify(docs: DataFrame, labels: DataFrame, seen: str = "crc32(cast(doc_id as string)) % 3 <> 1", cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs(doc_id, text); held_out: the predicate seen doesn't hold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    told = F.coalesce(F.expr(f"not ({seen})"), F.lit(False)).alias("held_out")
    rows, score = with_scores(docs.select("doc_id", "text"), labels, seen, cut, scratch, keep=["doc_id"])
    return rows.select("doc_id", told, score.alias("score"), (score >= cut).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, seen: str = "crc32(cast(doc_id as string)) % 3 <> 1", cut: float = 0.7) -> DataFrame:
    """The rows of docs that score under cut, with all of their columns."""
    rows, score = with_scores(docs, labels, seen, cut, Scratch(docs.sparkSession, "toxicity"), keep=docs.columns)
    return rows.filter(score < cut).select(*docs.columns)


def with_scores(docs: DataFrame, labels: DataFrame, seen: str, cut: float, scratch: Scratch, keep: list[str]) -> tuple[DataFrame, Column]:
    """The columns keep of docs, each text read once, and the expression of its score."""
    known = allowed(labels, seen)
    model, fitted = fit(docs, known, scratch)
    if model is None:
        return docs.select(*keep), F.lit(0.0)
    names = (fresh(docs, "raw_score"), fresh(docs, "language_place"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, kinds = scored(sent.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(docs_at[k]) for k in keep), pa.array(raw), pa.array(kinds, pa.int32())], [*keep, *names])

    docs_at = {k: i for i, k in enumerate(docs.columns)}
    schema = StructType([*(docs.schema[k] for k in keep), StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    rows = scratch.keep(docs.mapInArrow(frugal(run), schema))
    calibrated(model, rows, names, known, fitted)
    bend = F.element_at(F.array(*[F.lit(float(x)) for x in model.bend]), F.col(names[1]) + 1)
    raw = F.col(names[0])
    return rows, F.when(raw < bend, cut * raw / bend * (1 - 1e-9)).otherwise(cut + (1 - cut) * (raw - bend) / (1 - bend))
