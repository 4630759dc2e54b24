"""Secrets in texts: fixed patterns, and Markov models of random strings and ordinary ones.

There is a character model for each kind of random string and for each kind of ordinary
one, trained from a labelled sample, and one of the texts themselves. A string is random
if the best random model is likelier than the best ordinary one, by a margin per letter.
"""

from __future__ import annotations

import random as chance
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparkrec.llm.common import documents, slices, stored

# The patterns of the base spans.
ASSIGN = (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6)
ACCESS = (r"AKIA[A-Z0-9]+", 20)
HEX = (r"[0-9a-f]+", 24)
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

ALPHABET = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
LETTERS = len(ALPHABET)
_OTHER = 255
_CLASS = bytes(ALPHABET.index(c) if c in ALPHABET else _OTHER for c in range(256))

SHORTEST = 20       # of a string the models judge
MARGIN = 0.3        # log-likelihood ratio a letter from which a string counts as random
SAMPLES = 600       # labelled strings of each kind
BYTES_AT_ONCE = 2_000_000

SPANS = "array<struct<kind: int, start: int, end: int>>"
SCAN = f"doc_id long, base {SPANS}, strings array<struct<start: int, end: int, text: string>>, ordinary array<long>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_STRINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


class Patterns:
    """Base spans of a text as (kind, start, end) in code points, and their secret parts."""

    def __init__(self) -> None:
        self.assign = re.compile(ASSIGN[0], re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS[0])
        # Only runs long enough; a shorter run is dropped anyway.
        self.hex = re.compile(HEX[0][:-1] + "{%d,}" % HEX[1])

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
        spans, secrets = [], []
        lower = text.lower()
        if any(k in lower for k in _KEYWORDS):
            for m in self.assign.finditer(text):
                if len(m[2]) >= ASSIGN[1]:
                    spans.append((0, *m.span()))
                    secrets.append(m[2])
        if "AKIA" in text:
            for m in self.access.finditer(text):
                if len(m[0]) >= ACCESS[1]:
                    spans.append((1, *m.span()))
                    secrets.append(m[0])
        for m in self.hex.finditer(text):
            spans.append((2, *m.span()))
            secrets.append(m[0])
        return sorted(spans, key=lambda s: (s[1], s[0])), secrets


def pair_counts(data: np.ndarray) -> np.ndarray:
    """How often each pair of letters of the alphabet stands in bytes of letter classes."""
    a, b = data[:-1], data[1:]
    both = (a != _OTHER) & (b != _OTHER)
    return np.bincount(a[both].astype(np.int32) * LETTERS + b[both], minlength=LETTERS * LETTERS)


def _scan_slice(patterns: Patterns, texts: list[str]) -> tuple[list, list, np.ndarray]:
    """Base spans, the strings to judge that they leave, and the pair counts outside both."""
    base = [patterns(t)[0] for t in texts]
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = b"\n".join(parts)
    data = np.frombuffer(raw, dtype=np.uint8)
    points = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    first = np.searchsorted(points, offsets)
    classes = np.frombuffer(raw.translate(_CLASS), dtype=np.uint8).copy()
    for own, spans in enumerate(base):
        for _, s, e in spans:  # a span's last code point is of one byte
            classes[points[first[own] + s]:points[first[own] + e - 1] + 1] = _OTHER
    inside = np.r_[False, classes != _OTHER, False]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    owners = np.searchsorted(offsets, starts, side="right") - 1
    places = np.searchsorted(points, starts) - first[owners]
    strings: list[list[dict]] = [[] for _ in texts]
    for a, b, own, at in zip(starts.tolist(), ends.tolist(), owners.tolist(), places.tolist()):
        strings[own].append({"start": at, "end": at + b - a, "text": raw[a:b].decode()})
        classes[a:b] = _OTHER  # what shall be judged is no evidence
    return base, strings, pair_counts(classes)


def scan(docs: DataFrame) -> DataFrame:
    """One reading of (doc_id, text): per document its base spans and the strings the models
    shall judge; per some megabytes of text a row (with null spans) of pair counts outside
    both. Stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns()
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(batch, pc.binary_length(text).to_pylist(), BYTES_AT_ONCE):
                base, strings, ordinary = _scan_slice(patterns, text.slice(a, b - a).to_pylist())
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base]
                n = b - a
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([batch.column("doc_id").slice(a, n), pa.nulls(1, pa.int64())]),
                    pa.array([*spans, None], _SPANS), pa.array([*strings, None], _STRINGS),
                    pa.array([None] * n + [ordinary.tolist()], pa.list_(pa.int64())),
                ], names=["doc_id", "base", "strings", "ordinary"])

    return stored(docs.mapInArrow(run, SCAN), "secrets")


# --- the labelled sample ------------------------------------------------------------------

# Alphabets of random strings.
RANDOM_KINDS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "url": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
}
# Parts of names, besides those of the standard library's modules.
WORDS = """account action active address admin after agent album amount answer apply archive argument array article assert
author balance banner batch before billing binary block board bottom branch browser bucket buffer build button cache
calendar call campaign cancel card catalog category center change channel chart check child choice city class client
clock close cloud cluster code color column command comment commit company config connect constant contact content
context control convert copy count country create credit current customer daily data database date debug decode default
delete deploy detail device dialog digest direct disable display document domain download driver edit element email
enable encode engine entity entry error event example expand export factory failure feature field file filter final
first folder font footer format forward frame friend function future gallery gateway general global graph group guest
handler hash header health height hidden history home host image import index info initial input insert instance
internal invoice item journal key label language large last latest layer layout length level library limit link list
local locale location logger login logout machine main manager market master match max media member memory menu merge
message meta method middle migration min mobile model module monitor month mouse name native network news next node
notification null number object offer office offset online open option order origin output owner package page panel
parent parser partner password path payment pending permission person phone photo picture pipeline plan platform player
plugin point policy pool popup port position post prefix preview price primary print private process product profile
project property provider public purchase query queue random range rating reader record reference region register
release remote remove render repeat report request reset resource response result return review right role root route
rule sample save scale schedule schema scope score screen script search second section select sender server service
session setting shape share shipping short show sidebar simple single size socket source space special stack staff
stage start state static status step storage store stream string style subject submit success summary supplier support
switch symbol system table target task template tenant test text theme thread ticket time title toggle tool top total
track transaction transfer tree trigger type unique unit update upload user utility valid value variable vendor version
video view visible wallet warning website weight widget width window worker wrapper writer year zone""".split()


def ordinary_words() -> list[str]:
    """Lower-case parts of names."""
    names = re.findall(r"[a-z]{3,}", " ".join(sys.stdlib_module_names))
    return sorted({*WORDS, *names})


def _ordinary(kind: str, rng: chance.Random, words: Sequence[str]) -> str:
    """An ordinary string of a kind, of SHORTEST letters or more."""
    def some(least: int, most: int) -> list[str]:
        return [rng.choice(words) for _ in range(rng.randint(least, most))]

    number = str(rng.choice([0, 1, 2, 3, 8, 10, 16, 64, 100, 128, 404, 1024, 2000, 2024]))
    while True:
        parts = some(3, 6)
        if kind == "snake":
            out = "_".join(parts) + rng.choice(["", "", "_" + number])
        elif kind == "constant":
            out = "_".join(parts).upper() + rng.choice(["", "", "_" + number])
        elif kind == "camel":
            out = rng.choice(["", "get", "set", "is", "on", "to"]) + "".join(p.capitalize() for p in parts)
            out = out if rng.random() < 0.5 else out[0].lower() + out[1:]
        elif kind == "kebab":
            out = "-".join(parts) + rng.choice(["", "", "-" + number])
        elif kind == "path":
            out = rng.choice(["/", "", "src/", "usr/", "home/"]) + "/".join(rng.choice([p, p, p.capitalize(), p + "_" + rng.choice(words), p + number]) for p in parts)
        elif kind == "url":
            out = rng.choice(["https//", "http//", "//", "www/", "=https//"]) + "/".join(parts) + rng.choice(["", "/", "/" + number, "=" + number])
        elif kind == "ruler":
            out = rng.choice(["-", "=", "_", "+", "/", "x", "0", "-=", "+-", "=-", "-_", "ab", "12"]) * rng.randint(10, 60)
        elif kind == "number":
            out = rng.choice(["2024-01-15-10-30-00", "1234567890" * 3, "0" * 24, "1000000000000000000000", "9" * 22,
                              "-".join(f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(3)),
                              "-".join(str(rng.randint(1, 31)) for _ in range(10)), "=".join([number] * 8)])
        else:
            out = "".join(parts)
        if len(out) >= SHORTEST:
            return out


ORDINARY_KINDS = ("snake", "constant", "camel", "kebab", "path", "url", "ruler", "number", "plain")


def labelled(n: int = SAMPLES, words: Sequence[str] | None = None, seed: int = 0) -> list[tuple[str, bool, str]]:
    """text, secret and kind: n strings of each kind, made from a seed. Random ones are letters
    drawn from an alphabet; ordinary ones are names, paths, addresses, rulers and numbers."""
    words = words or ordinary_words()
    out = []
    for kind, letters in RANDOM_KINDS.items():
        rng = chance.Random(f"{seed}{kind}")
        out += [("".join(rng.choice(letters) for _ in range(rng.randint(20, 64))), True, kind) for _ in range(n)]
    for kind in ORDINARY_KINDS:
        rng = chance.Random(f"{seed}{kind}")
        out += [(_ordinary(kind, rng, words), False, kind) for _ in range(n)]
    return out


# --- the models ---------------------------------------------------------------------------

def transitions(counts: np.ndarray) -> np.ndarray:
    """Log probability of each letter after each other. Where pairs are rare it leans to how
    often the second letter occurs at all."""
    n = counts.reshape(LETTERS, LETTERS) + 0.0
    single = (n.sum(axis=0) + 0.05) / (n.sum() + 0.05 * LETTERS)
    return np.log((n + 8.0 * single) / (n.sum(axis=1, keepdims=True) + 8.0)).ravel()


class Models:
    """One row of log probabilities for each kind."""

    def __init__(self, random: Sequence[np.ndarray], ordinary: Sequence[np.ndarray]):
        self.random, self.ordinary = np.array(random), np.array(ordinary)

    def score(self, text: str) -> float:
        """How much likelier a string of the alphabet is as a random one, in logs a letter."""
        classes = np.frombuffer(text.encode().translate(_CLASS), dtype=np.uint8).astype(np.int64)
        pairs = classes[:-1] * LETTERS + classes[1:]
        return float(self.random[:, pairs].sum(axis=1).max() - self.ordinary[:, pairs].sum(axis=1).max()) / max(1, len(pairs))


def sampled(samples: Sequence[tuple[str | None, bool | None, str]]) -> Models:
    """Models of labelled strings (text, secret, kind); those without a label are left out."""
    groups: dict[tuple[bool, str], list[str]] = {}
    for text, secret, kind in samples:
        if text and secret is not None:
            groups.setdefault((secret, kind), []).append(text)
    made: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for (secret, _), texts in sorted(groups.items()):
        data = "\n".join(texts).encode("utf-8", "replace").translate(_CLASS)
        made[secret].append(transitions(pair_counts(np.frombuffer(data, dtype=np.uint8))))
    flat = transitions(np.zeros(LETTERS * LETTERS))
    return Models(made[True] or [flat], made[False] or [flat])


def train(seen: DataFrame, samples: Sequence[tuple[str | None, bool | None, str]] | None = None) -> Models:
    """The models of the labelled sample, and one more ordinary one of all text outside the base
    spans and what is to be judged: the tasks' counts are summed by pair, and LETTERS^2 rows at most come to the driver."""
    pairs = (seen.where("ordinary IS NOT NULL").select(F.posexplode("ordinary").alias("pair", "n"))
             .groupBy("pair").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(LETTERS * LETTERS)
    for row in pairs:
        counts[row["pair"]] = row["n"]
    models = sampled(labelled() if samples is None else samples)
    return Models(models.random, [*models.ordinary, transitions(counts)])


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN,
                 samples: Sequence[tuple[str | None, bool | None, str]] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of secrets.

    Spans of the three base patterns always stay. Of what they leave, strings of SHORTEST
    letters of the alphabet or more are added as "random" where the models' log-likelihood
    ratio is at least `margin` a letter. `samples` (text, secret, kind) are a bounded list in
    the place of `labelled()`; the model of ordinary text is learned from all of `docs`.

    Null and empty texts have no spans; repeated rows have equal ones; an empty table
    gives no rows. Other columns are not read.
    """
    seen = scan(documents(docs, id_col, text_col))
    models = train(seen, samples)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, strings in zip(batch.column("base").to_pylist(), batch.column("strings").to_pylist()):
                more = [{"kind": 3, "start": s["start"], "end": s["end"]} for s in strings if models.score(s["text"]) >= margin]
                out.append(sorted(base + more, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return seen.where("base IS NOT NULL").select("doc_id", "base", "strings").mapInArrow(judge, f"doc_id long, spans {SPANS}")


def report(spans: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, a digest of them, and all spans as text."""
    def joined(items):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return spans.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), number(3).alias("n_random"))
