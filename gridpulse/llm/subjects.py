"""Subject areas of documents (problem 9).

A complement naive Bayes model over sentences is trained from labelled documents: every sentence may be of each of its
document's labels or of none (the background class), weakly of others. Expectation-maximization then goes over all
documents, labelled or not: sentences get posteriors, posteriors give new counts. Last, each area's margin is calibrated
to an independent posterior on labelled sentences. A document treats the areas that at least SHARE of its sentences on
any area are of.

Texts are read once: the feature ids of each document's sentences go into a table in the shared folder, and the rounds of
expectation-maximization and the classification work on the ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.words import fold
from gridpulse.plans.lineage import blocks, bounded_rows, kept

SHARE = 0.25
#: Bound of the labelled sample the model is fitted on: the documents with the least hash of their id.
LABELLED = 4_000
MOST_AREAS = 500
#: Characters of evaluation items that are handed to every task at a time; more are taken in several blocks.
MOST_ITEM_CHARS = 20_000_000
ROUNDS_LABELLED, ROUNDS_ALL = 4, 2
ALPHA = 0.1
#: Weight of the background and of areas that are not among a document's labels, as labels may be wrong or missing.
BACKGROUND, UNLABELLED = 0.5, 0.02
#: Words and their pairs say much the same, so evidence is tempered in expectation steps.
TEMPER = 0.5
PASSAGE = 5

_PREFIX = re.compile(r"(?m)^[^\w\[\n]*(?:\[\d{1,2}:\d{2}\][^\S\n]*\w+:[^\S\n]*|\d{1,3}[.)][^\S\n]+)")
_STOP = re.compile(r"(?<=[.!?;])\s+|\n+")
#: A word, or the end of a sentence.
_PIECE = re.compile(r"[^\W\d_]+|[.!?;](?=\s)|\n")
_ENDS = {end: -2 for end in ".!?;\n"}
_DIGITS = set("0123456789")
_WORD, _NUMBER = re.compile(r"[^\W\d_]+|\d+"), re.compile(r"\d+")


def clean(text: str) -> str:
    """Folded, one kind of line end, without list numbers and speakers."""
    return _PREFIX.sub("", fold(text).replace("\r", "\n"))


def sentences(text: str | None) -> list[list[str]]:
    """The folded words of each sentence; line marks, list numbers and speakers are no part of one."""
    if not text:
        return []
    return [ws for raw in _STOP.split(clean(text)) if (ws := _WORD.findall(raw))]


def features(ws: list[str]) -> list[str]:
    """Words and neighbouring pairs, without numbers."""
    clean = [w for w in ws if not w.isdigit()]
    return clean + [f"{a} {b}" for a, b in zip(clean, clean[1:])]


@dataclass
class Passages:
    """Runs of PASSAGE words of evaluation items that hold a name or a number, so natural sentences do not share them."""

    runs: set[tuple[str, ...]]
    marks: set[str]  # the names and numbers in them

    def quoted(self, ws: list[str]) -> bool:
        if self.marks.isdisjoint(ws):
            return False
        return any(tuple(ws[i : i + PASSAGE]) in self.runs for i in range(len(ws) - PASSAGE + 1))

    def plain(self, text: str | None, skip: set[int] | None = None) -> list[list[str]]:
        """The sentences of a text without those of evaluation items, or without those of the given numbers."""
        return [ws for n, ws in enumerate(sentences(text)) if not (self.quoted(ws) if skip is None else n in skip)]


def passages(texts: list[str | None]) -> Passages:
    found = Passages(set(), set())
    for text in texts:
        for raw in _STOP.split(text or ""):
            marked = [(fold(m.group()), m.group().isdigit() or (m.start() > 1 and m.group()[0].isupper())) for m in _WORD.finditer(raw)]
            for i in range(len(marked) - PASSAGE + 1):
                run = marked[i : i + PASSAGE]
                if special := {w for w, named in run if named}:
                    found.runs.add(tuple(w for w, _ in run))
                    found.marks |= special
    return found


#: Feature ids of sentences in a row, where each sentence begins, and its document's number.
Known = tuple[np.ndarray, np.ndarray, np.ndarray]


class Seen(dict):
    """Numbers of words as they are written, folded when first met; marks: those whose folded form is a mark."""

    def __init__(self, numbers: dict[str, int], names: set[str]):
        super().__init__(_ENDS)
        self.numbers, self.names, self.marks = numbers, names, set()
        self.plain, self.odd = set(), set()

    def __missing__(self, word: str) -> int:
        form = fold(word)
        if form in self.names:
            self.marks.add(word)
        n = self.numbers.get(form, -1)
        if len(self) < 1 << 20:
            self[word] = n
        return n

    def folds_by_word(self, chars: set[str]) -> bool:
        """Folding these characters moves no border of a word or a sentence, so words may be folded one by one."""
        for ch in chars - self.plain - self.odd:
            form, low = fold(ch), ch.lower()
            same = form == low or (len(low) == len(form) == 1 and low.isalpha() and form.isalpha())
            (self.plain if same and not (low.isalnum() and not low.isalpha() and not low.isdecimal()) else self.odd).add(ch)
        return chars.isdisjoint(self.odd)


@dataclass
class Model:
    areas: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # features x (areas + background): minus log of the complement's share
    slope: np.ndarray
    shift: np.ndarray
    _lexicon: tuple | None = None
    _seen: Seen | None = None

    def lexicon(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Numbers of words, and the sorted keys of pairs of them with their feature ids."""
        if self._lexicon is None:
            numbers: dict[str, int] = {}
            for f in self.vocabulary:
                for w in f.split(" "):
                    numbers.setdefault(w, len(numbers))
            single = np.full(len(numbers), -1, dtype=np.int64)
            pairs = []
            for f, i in self.vocabulary.items():
                ws = f.split(" ")
                if len(ws) == 1:
                    single[numbers[f]] = i
                else:
                    pairs.append((numbers[ws[0]] << 32 | numbers[ws[1]], i))
            pairs.sort()
            keys = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            self._lexicon = {**numbers, **_ENDS}, single, keys[:, 0].copy(), keys[:, 1].copy()
        return self._lexicon

    def known(self, texts: list[str | None], quotes: Passages, skips: list[set[int] | None] | None = None) -> Known:
        """Feature ids of all sentences in a row, where each sentence begins, and its document's number.

        Words are looked up one by one, pairs all at once by their numbers. Only texts that hold a name or number of an
        evaluation item are looked at sentence by sentence, to leave out those that quote one. skips: for each text the
        numbers of the sentences to leave out instead, if the items were searched in blocks before.
        """
        numbers, single, pair_keys, pair_ids = self.lexicon()
        if self._seen is None or self._seen.names is not quotes.marks:
            self._seen = Seen(numbers, quotes.marks)
        seen = self._seen
        flat: list[int] = []
        lengths: list[int] = []
        for n, text in enumerate(texts):
            if not text:
                lengths.append(0)
                continue
            chars = set(text)
            plain = _PREFIX.sub("", text.lower().replace("\r", "\n")) if seen.folds_by_word(chars) else clean(text)
            pieces = _PIECE.findall(plain)
            own = [seen[w] for w in pieces]
            if skips:
                quoting = bool(skips[n])
            else:
                quoting = not seen.marks.isdisjoint(pieces) or not (_DIGITS.isdisjoint(chars) and plain.isascii() or seen.names.isdisjoint(_NUMBER.findall(plain)))
            if quoting:
                own = [numbers.get(w, -1) for ws in quotes.plain(text, skips[n] if skips else None) for w in [*(x for x in ws if not x.isdigit()), "\n"]]
            flat += own
            flat.append(-2)
            lengths.append(len(own) + 1)
        x = np.array(flat, dtype=np.int64)
        if not len(x):
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        sentence = np.cumsum(x == -2)
        word = x >= 0
        one = np.where(word, single[np.maximum(x, 0)] if len(single) else -1, -1)
        at = np.nonzero(word[:-1] & word[1:])[0]
        keys = x[at] << 32 | x[at + 1]
        slot = np.searchsorted(pair_keys, keys)
        hit = (slot < len(pair_keys)) & (pair_keys[np.minimum(slot, max(len(pair_keys) - 1, 0))] == keys if len(pair_keys) else False)
        singles = np.nonzero(one >= 0)[0]
        ids, place = np.concatenate([one[singles], pair_ids[slot[hit]]]), np.concatenate([sentence[singles], sentence[at[hit]]])
        order = np.argsort(place, kind="stable")
        ids, place = ids[order], place[order]
        starts = np.nonzero(np.diff(place, prepend=-1))[0] if len(place) else np.empty(0, dtype=np.int64)
        document = np.repeat(np.arange(len(texts)), lengths)
        first = np.concatenate([[0], np.nonzero(x == -2)[0][:-1] + 1])  # where each sentence begins
        return ids, starts, document[np.minimum(first[place[starts]], len(x) - 1)]

    def summed(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty((0, len(self.areas) + 1))
        return np.add.reduceat(self.weights[ids], starts, axis=0)

    def scores(self, texts: list[str | None], quotes: Passages) -> tuple[np.ndarray, np.ndarray]:
        """(sentences x classes) scores and the document number of each sentence with known features."""
        ids, starts, owner = self.known(texts, quotes)
        return self.summed(ids, starts), owner

    def margins(self, scores: np.ndarray) -> np.ndarray:
        """Each area's score less the best other class's."""
        top = np.sort(scores, axis=1)[:, -2:]
        best = np.where(scores == top[:, 1:], top[:, :1], top[:, 1:])
        return (scores - best)[:, :-1]

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(scores) * self.slope + self.shift, -50, 50)))


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """-log of each feature's share in all other classes; features x classes."""
    rest = counts.sum(1, keepdims=True) - counts + ALPHA
    return -np.log(rest / rest.sum(0, keepdims=True))


def softmax(scores: np.ndarray, prior: np.ndarray) -> np.ndarray:
    x = scores + np.log(prior)
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def add_counts(counts: np.ndarray, model: Model, known: Known, n_docs: int, prior: np.ndarray | None) -> None:
    """One E step: the expected counts of features in classes, added in place. prior: a row for each document."""
    ids, starts, owner = known
    if not len(starts):
        return
    scores = TEMPER * model.summed(ids, starts)
    if prior is None:  # the document's own sentences say which areas it is likely to treat
        flat = np.full(counts.shape[1], 1.0)
        flat[-1] = BACKGROUND
        prior = np.full((n_docs, counts.shape[1]), UNLABELLED)
        np.add.at(prior, owner, softmax(scores, flat[None, :]))
        prior /= np.maximum(prior[:, :-1].max(1, keepdims=True), UNLABELLED)
        prior[:, -1] = BACKGROUND
    p = np.repeat(softmax(scores, prior[owner]), np.diff(np.append(starts, len(ids))), axis=0)
    for c in range(counts.shape[1]):
        counts[:, c] += np.bincount(ids, weights=p[:, c], minlength=len(counts))


def fit_labelled(texts: list[str], labels: list[set[str]], areas: list[str], known: Passages, skips: list[set[int] | None] | None = None) -> tuple[Model, Known, np.ndarray]:
    """The model, the feature ids of the labelled sentences and the documents' priors."""
    docs = [known.plain(t, skips[n] or set() if skips else None) for n, t in enumerate(texts)]
    seen: Counter[str] = Counter(f for ss in docs for ws in ss for f in set(features(ws)))
    least = 2 if len(docs) > 50 else 1
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    prior = np.full((len(docs), len(areas) + 1), UNLABELLED)
    for n, own in enumerate(labels):
        prior[n, [areas.index(a) for a in own if a in areas]] = 1.0
    prior[:, -1] = BACKGROUND
    k = len(areas)
    model = Model(areas, vocabulary, np.zeros((len(vocabulary), k + 1)), np.ones(k), np.zeros(k))
    del docs, seen
    known_features = model.known(texts, known, skips)
    for _ in range(1 + ROUNDS_LABELLED):
        counts = np.zeros((len(vocabulary), k + 1))
        if vocabulary:
            add_counts(counts, model, known_features, len(prior), prior)
            model.weights = complement_weights(counts)
    return model, known_features, prior


def calibrate(model: Model, known: Known, prior: np.ndarray) -> None:
    """Platt scaling of each area's margin against the posterior that knows the document's labels."""
    ids, starts, owner = known
    scores = model.summed(ids, starts)
    if not len(owner):
        return
    target, margin = softmax(TEMPER * scores, prior[owner])[:, :-1], model.margins(scores)
    for c in range(len(model.areas)):
        x, t = np.clip(margin[:, c], -30, 30), target[:, c]
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
            g = np.array([((p - t) * x).sum() + 1e-2 * (w[0] - 1), (p - t).sum() + 1e-2 * w[1]])
            h = p * (1 - p)
            m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
            w = w - np.clip(np.linalg.solve(m, g), -1, 1)
        model.slope[c], model.shift[c] = max(w[0], 0.05), w[1]


def refined(model: Model, features_of: DataFrame) -> Model:
    """One round of expectation-maximization over every document's feature ids; each task sums its counts before the shuffle."""
    k = len(model.areas) + 1
    shared = features_of.sparkSession.sparkContext.broadcast((model.areas, model.weights))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        areas, weights = shared.value
        m = Model(areas, {}, weights, np.ones(k - 1), np.zeros(k - 1))
        counts = np.zeros((len(weights), k))
        for b in small_batches(batches):
            add_counts(counts, m, unpacked(b), len(b), None)
        used = np.nonzero(counts.sum(1) > 0)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(counts[used, i]) for i in range(k))], names=["f", *(f"c{i}" for i in range(k))])

    shape = "f long, " + ", ".join(f"c{i} double" for i in range(k))
    summed = features_of.select("ids", "lengths").mapInArrow(expect, shape).groupBy("f").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])
    counts = np.zeros((len(model.vocabulary), k))
    for r in bounded_rows(summed, len(model.vocabulary), "the model's vocabulary"):
        counts[r[0]] = r[1:]
    return Model(model.areas, model.vocabulary, complement_weights(counts), model.slope, model.shift)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Pieces whose scores fit the processor's cache."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def unpacked(batch: pa.RecordBatch) -> Known:
    """Feature ids, sentence starts and document numbers of a batch of the feature table."""
    ids, lengths = batch.column(batch.schema.get_field_index("ids")), batch.column(batch.schema.get_field_index("lengths"))
    flat, each = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(batch)), lengths.value_lengths().to_numpy(zero_copy_only=False))
    return flat, np.cumsum(each) - each, owner


def packed(keys: pa.Array, known: Known, name: str) -> pa.RecordBatch:
    """The documents that have any known feature, as rows (key, ids, lengths of the sentences)."""
    ids, starts, owner = known
    lengths = np.diff(np.append(starts, len(ids)))
    have = np.unique(owner)
    sentences_of = np.bincount(owner, minlength=len(keys))[have]
    ids_of = np.bincount(owner, weights=lengths, minlength=len(keys)).astype(np.int64)[have]
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(have)), lists(ids_of, ids), lists(sentences_of, lengths)], names=[name, "ids", "lengths"])


def feature_table(documents: DataFrame, key: str, column: str, model: Model, quotes: Passages) -> DataFrame:
    """(key, ids, lengths) of every document with known features, kept in the shared folder."""
    shared = documents.sparkSession.sparkContext.broadcast((model, quotes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, items = shared.value
        for b in batches:
            for at in range(0, len(b), 2000):
                some = b.slice(at, 2000)
                skips = [set(x) if x else None for x in some.column(2).to_pylist()] if some.num_columns > 2 else None
                yield packed(some.column(0), m.known(some.column(1).to_pylist(), items, skips), key)

    kind = documents.schema[key].dataType.simpleString()
    columns = [key, column] + [c for c in documents.columns if c == SKIP]
    return kept(documents.where(F.col(column).isNotNull()).select(*columns).mapInArrow(run, f"`{key}` {kind}, ids array<int>, lengths array<int>"))


SKIP = "__skip"


def marked(documents: DataFrame, key: str, column: str, items: list[DataFrame]) -> DataFrame:
    """documents with the numbers of the sentences that quote an item; each block of items is met in a pass of its own."""
    texts = documents.where(F.col(column).isNotNull()).select(key, column).withColumn("__hash", F.xxhash64(column))
    hits = None
    for block in items:
        shared = documents.sparkSession.sparkContext.broadcast(passages([r[0] for r in block.collect()]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(k, h, n) for k, t, h in zip(b[key], b[column], b["__hash"]) for n, ws in enumerate(sentences(t)) if shared.value.quoted(ws)]
                yield pd.DataFrame(rows, columns=[key, "__hash", "n"]).astype({key: "int64", "__hash": "int64", "n": "int32"})

        found = texts.where(F.col(key).isNotNull()).mapInPandas(run, f"`{key}` long, __hash long, n int")
        hits = found if hits is None else hits.unionByName(found)
    return texts.join(hits.groupBy(key, "__hash").agg(F.collect_set("n").alias(SKIP)), [key, "__hash"], "left").drop("__hash")


def fitted(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame, key: str, column: str, labelled: int = LABELLED, most_chars: int = MOST_ITEM_CHARS) -> tuple[Model, Passages, DataFrame]:
    """The model, the evaluation passages (none if they were taken in blocks) and the feature table of all documents."""
    names = sorted(r[0] for r in bounded_rows(areas.where("area IS NOT NULL").select("area").distinct(), MOST_AREAS, "the list of areas"))
    parts = blocks(items.where("texto IS NOT NULL").select("texto").distinct(), F.length("texto"), most_chars)
    if len(parts) == 1:
        known = passages([r[0] for r in parts[0].collect()])
    else:
        known, documents = passages([]), marked(documents, key, column, parts)
    own = labels.where(F.col(key).isNotNull() & F.col("area").isin(names)).groupBy(key).agg(F.collect_set("area").alias("__own"))
    # the sample is chosen among the labels, then met in one scan: the texts are not shuffled
    chosen = F.broadcast(own.orderBy(F.xxhash64(key), key).limit(labelled))
    sample = documents.where(F.col(column).isNotNull()).select(key, column, *[c for c in documents.columns if c == SKIP]).join(chosen, key).collect()
    sample.sort(key=lambda r: r[key])
    skips = [set(r[SKIP] or ()) for r in sample] if len(parts) > 1 else None
    model, features_of, prior = fit_labelled([r[column] for r in sample], [set(r["__own"]) for r in sample], names, known, skips)
    table = feature_table(documents, key, column, model, known)
    if model.vocabulary:
        for _ in range(ROUNDS_ALL):
            model = refined(model, table)
    calibrate(model, features_of, prior)
    return model, known, table


def decided(p: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, area, sentences, all its sentences on any area): each area's posterior is judged for itself."""
    sentence, area = np.nonzero(p >= 0.5)
    total = np.bincount(owner[(p >= 0.5).any(1)], minlength=int(owner.max(initial=-1)) + 1)
    pair, n = np.unique(owner[sentence] * p.shape[1] + area, return_counts=True)
    document = pair // p.shape[1]
    return document, pair % p.shape[1], n, total[document]


def subject_shares(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", labelled: int = LABELLED, most_chars: int = MOST_ITEM_CHARS) -> DataFrame:
    """(doc_id, area, sentences, share): sentences on each area and their share of all sentences on any area.

    A sentence is on every area of which its calibrated posterior is at least a half, each judged independently; sentences
    of evaluation items are on none. Null, empty and junk documents have no row; without labels there is no model and no
    row; repeated labels count once, labels outside the list of areas and null ids are left out.
    """
    model, _, table = fitted(documents, labels, areas, items, key, column, labelled, most_chars)
    shared = documents.sparkSession.sparkContext.broadcast((model.areas, model.weights, model.slope, model.shift))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *learned = shared.value
        m = Model(names, {}, *learned)
        for b in small_batches(batches):
            ids, starts, owner = unpacked(b)
            if len(starts):
                document, area, n, total = decided(m.posteriors(m.summed(ids, starts)), owner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(document)), pa.array(names).take(pa.array(area)), pa.array(n, pa.int64()), pa.array(n / total)], names=[key, "area", "sentences", "share"])

    kind = documents.schema[key].dataType.simpleString()
    return table.where(F.col(key).isNotNull()).mapInArrow(classify, f"`{key}` {kind}, area string, sentences long, share double")


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, area): the areas that at least SHARE of a document's sentences on any area treat."""
    shares = subject_shares(documents, labels, areas, items, **how)
    return shares.where(F.col("share") >= SHARE).select(shares.columns[0], "area").distinct()
