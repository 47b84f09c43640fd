"""License scans: a paragraph classifier over word n-grams, confirmed by template comparison.

The model is a multinomial logistic regression over hashed counts of single words and word pairs,
with one class per licence family and one for everything else. It is trained on a bounded number
of paragraphs of the corpus and on templates set into such paragraphs; a temperature fitted on
held-out rows calibrates its probabilities.

Texts are scored in windows of several lengths that begin at every word. A paragraph ends at a line
without a word, so a notice may be wrapped over lines, stand inside a very long line, or share its
line with others. Windows whose calibrated unknown class stays under a limit propose their best
family. Near them, runs of words are compared with the templates of that family alone: a run that
holds enough of a template's word pairs, and that the classifier gives to the same family, is a
confirmed notice. Of runs that overlap, the one that agrees best is taken. What is proposed and not
confirmed, as a reworded notice is, comes out as such with its probability.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.text import NOT_ALNUM, Words, chunks, mixed, scan, word_hashes
from ridelake.operators.scale import materialized

UNKNOWN = "unknown"
#: Notices of the licence families; digits count as one, whatever they are.
TEMPLATES = [
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
]
#: Bounds of the labelled rows that the model is fitted on: plain paragraphs, and templates set
#: into paragraphs. Everything else, scoring included, covers all rows.
PLAIN_ROWS = 12_000
TEMPLATE_ROWS = 6_000
#: Hash buckets of single words, and as many of word pairs.
FEATURES = 1 << 14
#: Text scored at once, and words of it whose windows are.
SCORED_BYTES = 1_500_000
SCORED_WORDS = 1 << 15
#: Words of the windows that are scored.
WINDOWS = [3, 6, 12, 24]
MAX_UNKNOWN = 0.5
#: Least probability of the family of a notice that no template confirms.
MIN_CHANCE = 0.5
MIN_AGREEMENT = 0.8
MAX_PLAIN_AGREEMENT = 0.4
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
FAMILIES = [UNKNOWN, *sorted({family for family, _ in TEMPLATES})]


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, body): the lines of each text that hold a word, numbered from 0."""
    lines = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph", "body"),
    )
    return lines.where(F.col("body").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))


def plain(body: Column) -> Column:
    """Digits made equal, so that years and versions do not matter."""
    return F.regexp_replace(body, r"[0-9]+", "0")


_DIGITS = re.compile(rb"[0-9]+")


@dataclass
class Features:
    """Hashed words and word pairs of a chunk, by paragraph (up to a line without a word)."""

    words: Words
    first: np.ndarray  # first word of each paragraph
    doc: np.ndarray
    line: np.ndarray  # of each word, in its text
    single: np.ndarray  # feature number of each word
    pair: np.ndarray  # of each word with the next one; -1 at the end of a paragraph
    joint: np.ndarray  # 64-bit hash of each word with the next one

    @classmethod
    def of(cls, texts: list[bytes]) -> Features:
        words = scan(texts := [_DIGITS.sub(b"0", t) for t in texts], NOT_ALNUM, lower=True)
        owner = words.owner()
        lines = np.concatenate([[0], np.cumsum(words.buffer == 0x0A)])
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        line = lines[words.starts] - lines[1 + np.cumsum(sizes) - sizes][owner]
        fresh = np.ones(len(owner), dtype=bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (line[1:] > line[:-1] + 1)
        first = np.flatnonzero(fresh)
        h = word_hashes(words)
        single = (mixed(h.copy()) % np.uint64(FEATURES)).astype(np.int64)
        pair = np.full(len(h), -1, dtype=np.int64)
        joint = np.zeros(len(h), dtype=np.uint64)
        if len(h) > 1:
            joint[:-1] = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
            pair[:-1] = np.where(fresh[1:], -1, (joint[:-1] % np.uint64(FEATURES)).astype(np.int64) + FEATURES)
        return cls(words, first, owner[first], line, single, pair, joint)

    def scores(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Class scores of each paragraph; ``weights`` has a row per feature and a last one of zeros."""
        if not len(self.first):
            return np.empty((0, len(bias)))
        both = weights[self.single]
        both += weights[self.pair]
        return np.add.reduceat(both, self.first, axis=0).astype(np.float64) + bias

    def window_scores(self, begin: int, stop: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Class scores of a run of words of one paragraph."""
        used = np.concatenate([self.single[begin:stop], self.pair[begin : stop - 1]])
        return weights[used].sum(axis=0, dtype=np.float64)[None] + bias


@dataclass
class Pattern:
    """Distinct word pairs of a template, and how many a run must hold within how many words."""

    family: str
    length: int
    pairs: np.ndarray
    need: int
    reach: int


@functools.cache
def patterns() -> tuple[Pattern, ...]:
    made = []
    for family, template in TEMPLATES:
        features = Features.of([template.encode()])
        pairs = np.unique(features.joint[features.pair >= 0])
        need = next(n for n in range(len(pairs) + 1) if n / len(pairs) >= MIN_AGREEMENT)
        made.append(Pattern(family, len(template), pairs, need, 2 * len(features.single) + 8))
    return tuple(made)


def _runs_of(pattern: Pattern, place: np.ndarray, pair: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(pairs held, first word, word behind the last) of runs that hold enough of a template.

    The three columns are the words at which a pair of the template begins, the pair, and the
    paragraph. Each run is the shortest one to its end that holds as many pairs.
    """
    more = pattern.need - 1
    n = max(len(place) - more, 0)
    close = np.flatnonzero((place[more:] - place[:n] < pattern.reach) & (part[more:] == part[:n]))
    for run in np.split(close, np.flatnonzero(np.diff(close) > more) + 1) if len(close) else []:
        at, kinds = place[run[0] : run[-1] + pattern.need].tolist(), pair[run[0] : run[-1] + pattern.need].tolist()
        held: dict[int, int] = {}
        left = 0
        for right, kind in enumerate(kinds):
            held[kind] = held.get(kind, 0) + 1
            while at[right] - at[left] >= pattern.reach or held[kinds[left]] > 1:
                left = _dropped(held, kinds, left)
            # A pair before the notice may belong to another one, so shorter runs count as well.
            rest, begin = dict(held), left
            while len(rest) >= pattern.need:
                yield len(rest), at[begin], at[right] + 2
                begin = _dropped(rest, kinds, begin)
                while begin < right and rest[kinds[begin]] > 1:
                    begin = _dropped(rest, kinds, begin)


def _dropped(held: dict[int, int], kinds: list[int], left: int) -> int:
    held[kinds[left]] -= 1
    if not held[kinds[left]]:
        del held[kinds[left]]
    return left + 1


@dataclass
class Windows:
    """Windows of words that the classifier takes for a licence, with its best family."""

    begin: np.ndarray
    stop: np.ndarray
    family: np.ndarray
    chance: np.ndarray

    def apart(self, taken: np.ndarray) -> Windows:
        """Those that hold no taken word."""
        before = np.concatenate([[0], np.cumsum(taken)])
        return self.where(before[self.stop] == before[self.begin])

    def where(self, keep: np.ndarray) -> Windows:
        return Windows(self.begin[keep], self.stop[keep], self.family[keep], self.chance[keep])

    def around(self, reach: int, n: int) -> np.ndarray:
        """For each of ``n`` words, whether a window is within ``reach`` words."""
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, np.maximum(self.begin - reach, 0), 1)
        np.add.at(edges, np.minimum(self.stop + reach, n), -1)
        return np.cumsum(edges[:-1]) > 0


def proposed(features: Features, model: LicenseModel) -> Windows:
    """Windows of ``WINDOWS`` words, cut at their paragraph's end, that are no plain text."""
    n = len(features.single)
    last = np.repeat(ends := np.append(features.first, n)[1:], ends - features.first)
    parts = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
    for low in range(0, n, SCORED_WORDS):
        high, far = min(n, low + SCORED_WORDS), min(n, low + SCORED_WORDS + max(WINDOWS))
        pair = model.odds[features.pair[low:far]]
        sums = np.zeros((far - low + 1, pair.shape[1]))
        np.cumsum(model.odds[features.single[low:far]] + pair, axis=0, dtype=np.float64, out=sums[1:])
        begin = np.arange(low, high)
        for size in WINDOWS:
            stop = np.minimum(begin + size, last[low:high])
            # The pair that begins at the last word leads out of the window.
            scores = sums[stop - low] - sums[: high - low] - pair[stop - 1 - low] + model.base
            # All families together can only outweigh the unknown class if one has its share.
            near = np.flatnonzero(scores.max(axis=1) > -model.temperature * np.log(scores.shape[1]))
            p = _softmax(np.pad(scores[near] / model.temperature, ((0, 0), (1, 0))))
            known = p[:, 0] < MAX_UNKNOWN
            family = 1 + p[known, 1:].argmax(axis=1)
            parts.append((begin[near[known]], stop[near[known]], family, p[known, family]))
    return Windows(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def notices(features: Features, model: LicenseModel) -> list[tuple[int, int, str, float, float, bool]]:
    """(first word, word behind the last, family, probability, agreement, confirmed) of a chunk's notices."""
    windows = proposed(features, model)
    if not len(windows.begin):
        return []
    n = len(features.single)
    known = np.unique(np.concatenate([p.pairs for p in patterns()]))
    which = np.minimum(np.searchsorted(known, features.joint), len(known) - 1)
    spots = np.flatnonzero((known[which] == features.joint) & (features.pair >= 0))
    which, part = which[spots], np.searchsorted(features.first, spots, side="right")
    ranked = []
    for pattern in patterns():
        same = windows.where(windows.family == FAMILIES.index(pattern.family))
        if not len(same.begin):
            continue
        own = np.isin(known, pattern.pairs)[which] & same.around(pattern.reach, n)[spots]
        for held, begin, stop in _runs_of(pattern, spots[own], which[own], part[own]):
            share = held / len(pattern.pairs)
            ranked.append((-share, -pattern.length, stop - begin, begin, pattern.family))
    taken = np.zeros(n, dtype=bool)
    found = []
    for share, _, size, begin, family in sorted(ranked):
        if not taken[begin : begin + size].any():
            p = model.probabilities(features, begin, begin + size)
            if p[0] < MAX_UNKNOWN and FAMILIES[1 + p[1:].argmax()] == family:
                taken[begin : begin + size] = True
                found.append((begin, begin + size, family, float(p.max()), -share, True))
    rest = windows.apart(taken)
    rest = rest.where(rest.chance >= MIN_CHANCE)
    for i in np.lexsort((rest.begin, rest.stop - rest.begin, -rest.chance)).tolist():
        begin, stop, family = int(rest.begin[i]), int(rest.stop[i]), FAMILIES[rest.family[i]]
        if not taken[begin:stop].any():
            taken[begin:stop] = True
            share = _held(features.joint[begin : stop - 1], family)
            found.append((begin, stop, family, float(rest.chance[i]), share, False))
    return sorted(found)


def _held(pairs: np.ndarray, family: str) -> float:
    """Largest share of a template of the family that some word pairs hold."""
    return max(float(np.isin(p.pairs, pairs).mean()) for p in patterns() if p.family == family)


def _pairs(body: Column) -> Column:
    """Distinct word pairs of a text, as the template comparison counts them."""
    words = F.filter(
        F.split(F.lower(plain(body)), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""
    )

    def joined(w: Column) -> Column:
        return F.array_distinct(
            F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        )

    return F.when(F.size(words) > 1, F.transform(F.array(words), joined)[0]).otherwise(words)


def agreement(body: Column) -> Column:
    """Struct (agreement, family) of the template whose word pairs ``body`` holds best."""

    def against(own: Column) -> Column:
        scored = []
        for family, template in sorted(TEMPLATES, key=lambda t: -len(t[1])):
            pairs = _pairs(F.lit(template))
            share = F.size(F.array_intersect(own, pairs)) / F.size(pairs)
            scored.append(
                F.struct(share.alias("agreement"), F.lit(len(template)).alias("length"), F.lit(family).alias("family"))
            )
        return F.array_max(F.array(*scored))

    return F.transform(F.array(_pairs(body)), against)[0]


@dataclass
class LicenseModel:
    """Class weights, temperature, and accuracy on held-out rows."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    held_out_accuracy: float

    @functools.cached_property
    def odds(self) -> np.ndarray:
        """Weights of the families against the unknown class."""
        return self.weights[:, 1:] - self.weights[:, :1]

    @property
    def base(self) -> np.ndarray:
        return self.bias[1:] - self.bias[0]

    def probabilities(self, features: Features, begin: int, stop: int) -> np.ndarray:
        """Calibrated probabilities of ``FAMILIES`` for a run of words."""
        return _softmax(features.window_scores(begin, stop, self.weights, self.bias) / self.temperature)[0]


def _softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    return shifted / shifted.sum(axis=1, keepdims=True) if len(scores) else scores


def labelled_rows(docs: DataFrame, plain_rows: int = PLAIN_ROWS, template_rows: int = TEMPLATE_ROWS) -> DataFrame:
    """(plain, label, held_out): at most ``plain_rows + template_rows`` labelled paragraphs.

    Plain rows are the paragraphs of the corpus with the smallest hashes (each text once), labelled
    with a family where they hold a template's word pairs; lines that hold a part of them only, as
    a wrapped notice's do, are neither one nor the other and have no label. Of plain rows without a
    notice, most are cut to the length of a scored window. Template rows are templates set before,
    behind, or without words of such a paragraph.
    """
    every = paragraphs(docs).select(plain(F.col("body")).alias("body")).withColumn("h", F.xxhash64("body"))
    # The bound is found on hashes alone; copies of a text then meet in one row.
    last = every.select("h").distinct().orderBy("h").limit(plain_rows).agg(F.max("h")).first()[0]
    bounded = every.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("body").alias("body"))
    chosen = materialized(bounded)
    met = agreement(F.col("body"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    family = F.when(met["agreement"] >= MIN_AGREEMENT, met["family"]).otherwise(F.lit(UNKNOWN))
    partly = (met["agreement"] >= MAX_PLAIN_AGREEMENT) & (met["agreement"] < MIN_AGREEMENT)
    short = F.get(F.array(*[F.lit(n) for n in WINDOWS]), F.pmod(F.shiftright("h", 16), F.lit(len(WINDOWS) + 1)).cast("int"))
    cut = F.when(family == UNKNOWN, F.array_join(F.slice(F.split("body", " "), F.lit(1), short), " "))
    ordinary = chosen.where(~partly).select(F.coalesce(cut, "body").alias("plain"), family.alias("family"), "h")
    notices = F.array(
        *[F.struct(F.lit(f).alias("family"), plain(F.lit(t)).alias("notice")) for f, t in TEMPLATES]
    )
    pick = F.get(notices, F.pmod(F.shiftright("h", 8), F.lit(len(TEMPLATES))).cast("int"))
    some = F.substring_index("body", " ", 12)
    form = F.pmod(F.shiftright("h", 24), F.lit(3))
    text = (
        F.when(form == 0, pick["notice"])
        .when(form == 1, F.concat_ws(" ", pick["notice"], some))
        .otherwise(F.concat_ws(" ", some, pick["notice"]))
    )
    notices_set = chosen.orderBy(F.desc("h")).limit(template_rows).select(
        text.alias("plain"), pick["family"].alias("family"), "h"
    )
    bare = docs.sparkSession.createDataFrame(
        [(t, f, i) for i, (f, t) in enumerate(TEMPLATES)], "plain string, family string, h long"
    ).select(plain(F.col("plain")).alias("plain"), "family", F.lit(1).cast("long").alias("h"))
    rows = ordinary.unionByName(notices_set).unionByName(bare)
    return rows.select(
        "plain",
        (F.array_position(names, F.col("family")) - 1).cast("double").alias("label"),
        (F.pmod(F.shiftright("h", 40), F.lit(5)) == 4).alias("held_out"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature numbers of labelled rows, as text, each row taken as one paragraph."""
    for rows, texts in chunks(batches, "plain", SCORED_BYTES):
        features = Features.of([t.replace(b"\n", b" ") for t in texts])
        ends = np.append(features.first[1:], len(features.single))
        numbers = []
        for begin, end in zip(features.first.tolist(), ends.tolist(), strict=True):
            used = np.concatenate([features.single[begin:end], features.pair[begin : end - 1]])
            numbers.append([str(x) for x in used.tolist()])
        yield pa.record_batch(
            [rows["label"].combine_chunks().take(pa.array(features.doc)), pa.array(numbers, pa.list_(pa.string()))],
            names=["label", "numbers"],
        )


def _losses(weights: np.ndarray, bias: np.ndarray):
    """Log losses of labelled rows at each temperature, and whether the best class is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, "plain", SCORED_BYTES):
            features = Features.of([t.replace(b"\n", b" ") for t in texts])
            scores = features.scores(weights, bias)
            labels = rows["label"].to_numpy()[features.doc].astype(np.int64)
            losses = [
                -np.log(np.maximum(_softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).sum() if len(labels) else 0.0
                for t in TEMPERATURES
            ]
            right = float((scores.argmax(axis=1) == labels).sum()) if len(labels) else 0.0
            yield pa.record_batch(
                [pa.array([len(labels)]), pa.array([right]), pa.array([losses], pa.list_(pa.float64()))],
                names=["n", "right", "losses"],
            )

    return run


def fit(docs: DataFrame, plain_rows: int = PLAIN_ROWS, template_rows: int = TEMPLATE_ROWS) -> LicenseModel:
    """Train on the labelled rows that are not held out, and calibrate on those that are.

    The two parameters bound the labelled rows. Tasks hash them, Spark ML fits them, and only
    class weights and sums of losses reach the driver.
    """
    # Imported here, as tasks that score import this module and should not hold Spark ML.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    rows = materialized(labelled_rows(docs, plain_rows, template_rows))
    hashed = rows.where("not held_out").select("plain", "label").mapInArrow(_hashed, "label double, numbers array<string>")
    # Counts of feature numbers become sparse vectors in the JVM.
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(2 * FEATURES)], inputCol="numbers", outputCol="features"
    )
    frame = counter.transform(hashed.coalesce(4)).select("label", "features")
    learner = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40)
    fitted = learner.fit(frame)
    weights = np.zeros((2 * FEATURES + 1, len(FAMILIES)), dtype=np.float32)
    bias = np.full(len(FAMILIES), -1e9)
    classes = fitted.numClasses
    weights[:-1, :classes] = fitted.coefficientMatrix.toArray().T
    bias[:classes] = fitted.interceptVector.toArray()
    tested = rows.where("held_out").select("plain", "label").mapInArrow(
        _losses(weights, bias), "n long, right double, losses array<double>"
    )
    sums = tested.agg(
        F.sum("n"), F.sum("right"), *[F.sum(F.get("losses", F.lit(i))) for i in range(len(TEMPERATURES))]
    ).first()
    if not sums[0]:
        return LicenseModel(weights, bias, 1.0, 0.0)
    best = min(range(len(TEMPERATURES)), key=lambda i: sums[2 + i])
    return LicenseModel(weights, bias, TEMPERATURES[best], sums[1] / sums[0])


def find_licenses(
    docs: DataFrame, model: LicenseModel, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, paragraph, body, family, probability, agreement, confirmed): notices that are licences.

    The family is the classifier's; ``confirmed`` says that a template of it agrees. ``paragraph``
    is the line on which the notice starts, from 0, ``body`` the text from its first to its last
    word (of an unconfirmed notice, those of its likeliest window). All notices of a line or paragraph are returned, whatever their families.
    Every text is compared whole. A null or empty text has none; repeated rows give repeated rows; a
    null id passes as it is; other columns are ignored. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, paragraph long, body string, family string, probability double, agreement double, confirmed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, limit=SCORED_BYTES):
            features = Features.of(texts)
            found = notices(features, shared.value)
            if not found:
                continue
            begin, stop, families, chance, share, confirmed = (list(c) for c in zip(*found, strict=True))
            first = features.words.first
            doc = np.searchsorted(first, begin, side="right") - 1
            # Words of the text as written; digits made equal leave their number as it is.
            some = np.unique(doc)
            written = scan(spelt := [texts[d] for d in some.tolist()], NOT_ALNUM, lower=True)
            back = np.searchsorted(some, doc)
            offset = written.first[back] - first[doc]
            starts, ends = written.starts[begin + offset], written.ends[np.array(stop) - 1 + offset]
            before = 1 + np.cumsum([0, *(len(t) + 1 for t in spelt)])[back]
            places = zip(back.tolist(), (starts - before).tolist(), (ends - before).tolist(), strict=True)
            body = [spelt[k][a:b] for k, a, b in places]
            yield pa.record_batch(
                [
                    rows["doc_id"].combine_chunks().take(pa.array(doc)),
                    pa.array(features.line[begin]),
                    pa.array(body, pa.binary()).cast(pa.string()),
                    pa.array(families, pa.string()),
                    pa.array(chance, pa.float64()),
                    pa.array(share, pa.float64()),
                    pa.array(confirmed, pa.bool_()),
                ],
                names=["doc_id", "paragraph", "body", "family", "probability", "agreement", "confirmed"],
            )

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(run, schema)
