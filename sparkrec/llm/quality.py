"""Quality and toxicity of documents: heuristic labellers, whose accuracies expectation-
maximisation estimates without truth, label the texts that train hashed linear scorers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkrec.llm.common import slices, stored
from sparkrec.llm.decontam import WORDS, find_words, mix

SIZE = 1 << 18          # of the hashed feature space
STYLE = 256             # places of it for marks of style, the rest is for words and their beginnings
BEGINNINGS = (4, 5, 6)  # bytes of a word's beginning
BLOCK = 200             # words among which repeated ones are counted
TRAIN_ROWS = 30_000     # documents whose features are kept for fitting, at most about so many
BYTES_AT_ONCE = 2_000_000
REJECT = 0.5            # probability of low quality from which a document is rejected
REJECT_TOXIC = 0.25     # the same for toxicity, where the scorer leans to the common case
LEAST_DOCS = 4          # of the fitted ones must have a feature for it to count
MOST_WEIGHT = 10.0      # of the rarer class against the other
TRUST = 0.99            # in a given label
EPOCHS = 12
BATCH = 128

# Insults in the four languages of the labellers, in two lists so that two
# labellers can overlap.
INSULTS = (
    ("idiot", "moron", "stupid", "pathetic", "scum", "imbecile", "dumb", "idiotisch", "abschaum", "dummkopf",
     "imbécile", "crétin", "ordure", "imbécil", "estúpido", "idiota"),
    ("loser", "worthless", "trash", "clown", "disgusting", "filthy", "freak", "wertlos", "versager", "widerlich",
     "minable", "pathétique", "dégoûtant", "basura", "inútil", "asqueroso"),
)

ABSTAIN, GOOD, BAD = 0, 1, 2
QUALITY_LABELLERS = ("marks", "shouting", "exclaiming", "bars", "repeats", "variety", "stops", "prose", "plain", "given")
TOXIC_LABELLERS = ("insults", "more insults", "given")
_RUN = re.compile(r"([!-/:-@\[-`{-~])\1\1")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def _above(value: float, bad: float) -> int:
    """BAD from a bound on, else no vote."""
    return BAD if value >= bad else ABSTAIN


def _code(votes: list[int]) -> int:
    return sum(v * 3 ** i for i, v in enumerate(votes))


def beginnings(data: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The first `size` (up to 7) bytes of each word that has more, as numbers unlike those
    of other sizes; 0 for shorter words."""
    raw = np.frombuffer(data + b" " * 8, dtype=np.uint8)
    number = np.full(len(starts), size, dtype=np.uint64)
    for j in range(size):
        number = (number << np.uint64(8)) | raw[starts + j]
    return np.where(ends - starts > size, mix(number), np.uint64(0))


def repeated(words: np.ndarray) -> float:
    """The mean share of words that came before in their block of BLOCK words: a measure that
    does not grow with the length of the text."""
    block = np.arange(len(words), dtype=np.uint64) // np.uint64(BLOCK) * np.uint64(0x9E3779B97F4A7C15)
    return 1 - len(np.unique(words + block)) / max(1, len(words)) if len(words) else 0.0


class Features:
    """Votes and hashed features of texts; every text is read whole."""

    def __init__(self) -> None:
        hashes = [find_words(w.encode().translate(WORDS))[2][0] for words in INSULTS for w in words]
        self.insults = [np.array(sorted(h)) for h in (hashes[:len(INSULTS[0])], hashes[len(INSULTS[0]):])]

    def __call__(self, texts: list[str]) -> tuple[list[int], list[int], list[np.ndarray]]:
        parts = [t.encode("utf-8", "replace").translate(WORDS) for t in texts]
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        data = b" ".join(parts)
        starts, ends, words = find_words(data)
        heads = [beginnings(data, starts, ends, n) for n in BEGINNINGS]
        first = np.searchsorted(starts, offsets[:-1])
        last = np.searchsorted(starts, offsets[1:])
        quality, toxic, features = [], [], []
        for text, a, b in zip(texts, first.tolist(), last.tolist()):
            own = words[a:b]
            n = max(1, len(own))
            kinds = np.unique(own)
            raw = text.encode("utf-8", "replace")
            letters = len(raw) - len(raw.translate(None, _UPPER + _LOWER))
            shares = (
                len(_RUN.findall(text)) / n,
                (len(raw) - len(raw.translate(None, _UPPER))) / max(1, letters),
                text.count("!!") / n,
                text.count("|") / n,
                float(np.count_nonzero(own[1:] == own[:-1])) / n,
                repeated(own),
                sum(text.count(c) for c in ".,;:?!") / n,
            )
            found = [int(np.isin(kinds, x).sum()) for x in self.insults]
            prose = GOOD if 0.02 <= shares[6] <= 0.35 else ABSTAIN
            plain = GOOD if shares[1] < 0.3 and shares[0] + shares[2] + shares[3] < 0.02 else ABSTAIN
            quality.append(_code([
                _above(shares[0], 0.2), _above(shares[1], 0.5), _above(shares[2], 0.2), _above(shares[3], 0.2),
                _above(shares[4], 0.3), _above(shares[5], 0.8), _above(shares[6], 0.8), prose, plain]
                if len(own) else [ABSTAIN] * 9))
            toxic.append(_code([BAD if x else ABSTAIN for x in found]))
            bins = [i * 32 + min(31, int(s * 20)) for i, s in enumerate(shares)]
            kinds = np.concatenate([kinds, *(h[a:b] for h in heads)])
            hashed = STYLE + (kinds[kinds > 0] % np.uint64(SIZE - STYLE)).astype(np.int64)
            features.append(np.unique(np.r_[np.array(bins, dtype=np.int64), hashed]))
        return quality, toxic, features


def look(docs: DataFrame, fraction: float) -> DataFrame:
    """Of (id, key, text): id, key, votes of the heuristics for both questions as codes, and
    the features of a `fraction` of the documents, chosen by hash of the key. Stored."""
    limit = int(fraction * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Features()
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(batch, pc.binary_length(text).to_pylist(), BYTES_AT_ONCE):
                quality, toxic, features = read(text.slice(a, b - a).to_pylist())
                keys = batch.column("key").slice(a, b - a)
                kept = [f if k % 1_000_003 * 1_000_000 < limit * 1_000_003 else None for f, k in zip(features, keys.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), keys, pa.array(quality, pa.int32()), pa.array(toxic, pa.int32()),
                     pa.array(kept, pa.list_(pa.int32()))], names=["id", "key", "quality", "toxic", "features"])

    return stored(docs.mapInArrow(run, "id long, key long, quality int, toxic int, features array<int>"), "votes")


def estimate(counts: dict[int, int], labellers: int, truthful: int | None = None, rounds: int = 100
             ) -> tuple[dict[int, float], np.ndarray]:
    """Probability of BAD per vote pattern, and each labeller's table of votes given truth.

    Every labeller votes with its own probabilities given the truth, independently of the
    others; abstaining is a vote. Expectation-maximisation starts from the majority. Where
    the `truthful` one (given labels) votes, its vote is held at TRUST.
    """
    codes = np.array(sorted(counts))
    if not len(codes):
        return {}, np.full((labellers, 2, 3), 1 / 3)
    votes = codes[:, None] // 3 ** np.arange(labellers) % 3
    n = np.array([counts[c] for c in codes.tolist()], dtype=float)
    said = votes[:, truthful] if truthful is not None else np.zeros(len(codes), dtype=int)
    held = np.array([np.nan, 1 - TRUST, TRUST])[said]
    fixed = ~np.isnan(held)
    sides = np.stack([(votes == v).sum(axis=1) for v in (GOOD, BAD)], axis=1)
    bad = np.where(fixed, held, (2.0 * sides[:, 1] + 0.1) / (sides[:, 0] + 2.0 * sides[:, 1] + 1.0))
    table = np.zeros((labellers, 2, 3))
    for _ in range(rounds):
        both = np.stack([1 - bad, bad], axis=1) * n[:, None]
        for v in range(3):
            table[:, :, v] = ((votes == v)[:, :, None] * both[:, None, :]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        prior = both.sum(axis=0) + 1.0
        logs = np.log(prior / prior.sum()) + sum(np.log(table[j][:, votes[:, j]]).T for j in range(labellers))
        new = np.where(fixed, held, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500))))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return dict(zip(codes.tolist(), bad.tolist())), table


def values(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The value of each feature: 1 for those of style; those of words share the root of
    their document's number of features."""
    return np.where(places < STYLE, 1.0, np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths))


def fit(features: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the constant) by adaptive gradient
    steps; the rarer class counts more."""
    weights, squares = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-4)
    order = np.random.default_rng(0)
    known = np.bincount(np.concatenate(features), minlength=SIZE) >= LEAST_DOCS if len(features) else None
    features = [f[known[f]] for f in features]
    lengths = np.array([len(f) for f in features])
    rare = min(target.sum(), len(target) - target.sum())
    weight = min(MOST_WEIGHT, len(target) / max(rare, 1.0) - 1)
    costs = np.where((target > 0.5) == (target.mean() < 0.5), weight, 1.0) if len(features) else target
    use = np.flatnonzero(lengths)
    for _ in range(EPOCHS if len(use) else 0):
        for chosen in np.array_split(order.permutation(use), -(-len(use) // BATCH)):
            places = np.concatenate([features[i] for i in chosen])
            starts = np.cumsum(lengths[chosen]) - lengths[chosen]
            x = values(places, lengths[chosen])
            margin = np.add.reduceat(weights[places] * x, starts) + weights[SIZE]
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target[chosen]) * costs[chosen]
            touched, back = np.unique(places, return_inverse=True)
            slope = np.bincount(back, weights=np.repeat(error, lengths[chosen]) * x) / len(chosen)
            squares[touched] += slope ** 2
            weights[touched] -= slope / np.sqrt(squares[touched])
            step = error.mean()
            squares[SIZE] += step ** 2
            weights[SIZE] -= step / np.sqrt(squares[SIZE])
    return weights.astype(np.float32)


def _patterns(votes: DataFrame, column: str) -> dict[int, int]:
    """How often each vote pattern occurs; there are 3 ** labellers of them at most."""
    return {r[0]: r[1] for r in votes.groupBy(column).count().collect()}


class Model:
    """Scorers for both questions, and what was learned about the labellers."""

    def __init__(self, quality: np.ndarray, toxic: np.ndarray, accuracy: dict[str, np.ndarray]):
        self.quality, self.toxic, self.accuracy = quality, toxic, accuracy

    def scores(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of low quality and of toxicity."""
        if not features:
            return np.zeros(0), np.zeros(0)
        places, lengths = np.concatenate(features), np.array([len(f) for f in features])
        starts, x = np.cumsum(lengths) - lengths, values(places, lengths)
        out = []
        for w in (self.quality, self.toxic):
            margin = np.add.reduceat(w[places] * x, starts) + w[SIZE]
            out.append(1 / (1 + np.exp(-np.clip(margin, -50, 50))))
        return out[0], out[1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return rows.select("id", F.abs(F.xxhash64("id", "text") % (1 << 52)).alias("key"), "text")


def train(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
          train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from all of `docs` how far the labellers can be trusted, then fit the scorers.

    All documents are read once: every labeller votes on each, and the vote patterns are
    counted over the whole table. Given `labels` (doc_id, quality, toxic; 1 is good and
    toxic) are one more labeller; rows of one id count once, as bad if any says so. The
    scorers are fitted in one task to the posterior labels of about `train_rows`
    documents, chosen by hash: to those at least one labeller voted on. This bound is the
    only sample. A feature row has SIZE entries at most, however long the text.
    """
    keyed = _keyed(docs, id_col, text_col)
    total = max(1, docs.count())
    seen = look(keyed, min(1.0, train_rows / total))
    if labels is None:
        given = seen.select("id").limit(0).withColumns({"q": F.lit(0), "t": F.lit(0)})
    else:
        def side(bad: Column, good: Column) -> Column:
            return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
        given = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
            F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select(
            "id", side(F.col("quality") == 0, F.col("quality") == 1).alias("q"),
            side(F.col("toxic") == 1, F.col("toxic") == 0).alias("t"))
    q_place, t_place = len(QUALITY_LABELLERS) - 1, len(TOXIC_LABELLERS) - 1
    votes = stored(seen.join(given, "id", "left").select(
        "key", (F.col("quality") + F.coalesce("q", F.lit(0)) * 3 ** q_place).cast("int").alias("quality"),
        (F.col("toxic") + F.coalesce("t", F.lit(0)) * 3 ** t_place).cast("int").alias("toxic"), "features"), "patterns")
    bad_q, table_q = estimate(_patterns(votes, "quality"), len(QUALITY_LABELLERS), q_place)
    bad_t, table_t = estimate(_patterns(votes, "toxic"), len(TOXIC_LABELLERS), t_place)

    def fit_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, q, t = [], [], []
        for batch in batches:
            column = batch.column("features")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            features += [values[a:b] for a, b in zip(ends, ends[1:])]
            q += batch.column("quality").to_pylist()
            t += batch.column("toxic").to_pylist()
        for name, codes, bad in (("quality", q, bad_q), ("toxic", t, bad_t)):
            use = [i for i, c in enumerate(codes) if c]
            weights = fit([features[i] for i in use], np.array([bad[codes[i]] for i in use]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weights.tobytes()], pa.binary())], names=["name", "weights"])

    sample = votes.where("features IS NOT NULL AND (quality > 0 OR toxic > 0)").select("features", "quality", "toxic")
    fitted = sample.repartition(1).mapInArrow(fit_both, "name string, weights binary").collect()
    weights = {r["name"]: np.frombuffer(r["weights"], dtype=np.float32) for r in fitted}
    none = np.zeros(SIZE + 1, dtype=np.float32)
    return Model(weights.get("quality", none), weights.get("toxic", none),
                 {"quality": table_q, "toxic": table_t})


def _scored(docs: DataFrame, model: Model, text_col: str, schema: T.StructType, only_kept: bool) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Features()
        for whole in batches:
            text = pc.fill_null(whole.column(names.index(text_col)), "")
            for a, b in slices(whole, pc.binary_length(text).to_pylist(), BYTES_AT_ONCE):
                bad, toxic = model.scores(read(text.slice(a, b - a).to_pylist())[2])
                keep = pa.array((bad < REJECT) & (toxic < REJECT_TOXIC))
                batch = whole.slice(a, b - a)
                if only_kept:
                    yield batch.filter(keep)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 - bad), pa.array(toxic), keep], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """`docs` with quality and toxicity (probabilities) and keep. Scored where the rows are.

    A null text is scored as empty. A text without words has no labels of quality and is
    judged by the constant alone. Columns named like the results are replaced.
    """
    rows = docs.drop("quality", "toxicity", "keep")
    schema = T.StructType([*rows.schema, T.StructField("quality", T.DoubleType()), T.StructField("toxicity", T.DoubleType()),
                           T.StructField("keep", T.BooleanType())])
    return _scored(rows, model, text_col, schema, False)


def drop_rejected(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Those of `docs` that are neither of low quality nor toxic."""
    return _scored(docs, model, text_col, docs.schema, True)
