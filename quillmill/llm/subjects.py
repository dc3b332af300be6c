"""Subject areas of notes (problem 4): latent semantic embedding and refined seed centroids.

Texts, in their visual form, become hashed counts of words, word pairs and pairs of Han characters, weighted by inverse
document frequency and by how much the seed notes with a term keep to one subject, both over all notes, and are embedded by a truncated singular value decomposition of the whole note-term matrix
(randomised subspace iteration: each pass adds fixed-size partial sums). Each subject starts, for each script, from a
seed centroid of all notes that are labelled by hand with it alone and of notes whose stored domain fields agree; the centroids are then
refined over all notes by the sentences that are clearly nearest to them, until they stay where they are. A note is about a subject if enough of its sentences, counted by their cosine to
the nearest centroid, are about it; one sentence in passing is not. The thresholds are chosen on all labelled notes.

A note with neither letters in its title nor in its summary has no subject. Null texts are like empty ones; broken or
null domain fields give no seed. All statistics cover all notes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import filled_frames, materialize

from .visual import look_form
from .spans import _BASE, _mix, _power_tables, to_codes

BITS = 15
DIM = 1 << BITS
CHARS_AT_ONCE = 1 << 18
BLOCKS = 64


def _is_latin(c: np.ndarray) -> np.ndarray:
    return ((c >= 97) & (c <= 122)) | ((c >= 0xDF) & (c <= 0x24F) & (c != 0xF7))


def _is_han(c: np.ndarray) -> np.ndarray:
    return ((c >= 0x4E00) & (c <= 0x9FFF)) | ((c >= 0x3400) & (c <= 0x4DBF))


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, bucket) of each term, and the text of each segment.

    A segment is a sentence or line; the first segment of a text is its first line.
    """
    lowered = [t.lower() + "\n" for t in texts]
    lengths = np.array([len(t) for t in lowered], dtype=np.int64)
    c = to_codes("".join(lowered)).astype(np.int64)
    n = len(c)
    owner = np.repeat(np.arange(len(texts)), lengths)
    after = np.append(c[1:], 10)
    ends = np.isin(c, [10, 33, 63, 0x3002, 0xFF01, 0xFF1F]) | ((c == 46) & np.isin(after, [10, 32]))
    seg = np.concatenate([[0], np.cumsum(ends)[:-1]])
    of_text = owner[np.flatnonzero(ends)]
    han = _is_han(c)
    pair = np.flatnonzero(han[:-1] & han[1:])
    mixed = _mix((c[pair].astype(np.uint64) << np.uint64(24)) + c[pair + 1].astype(np.uint64) + np.uint64(0x51ED270B))
    latin = _is_latin(c)
    edge = np.diff(np.concatenate([[0], latin.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = last - first >= 2
    first, last = first[keep], last[keep]
    up, down = _power_tables(_BASE, n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_mix(c.astype(np.uint64) + np.uint64(77)) * up[:n], out=prefix[1:])
    word = _mix((prefix[last] - prefix[first]) * down[first])
    near = np.flatnonzero((first[1:] - last[:-1] == 1) & (seg[first[1:]] == seg[first[:-1]]))
    both = _mix(word[near] * np.uint64(0xC2B2AE3D27D4EB4F) + word[near + 1])
    h = np.concatenate([mixed, word, both])
    at = np.concatenate([pair, first, first[near]])
    return seg[at], (h >> np.uint64(64 - BITS)).astype(np.int64), of_text


def _counts(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with their number, sorted by row."""
    key, n = np.unique(rows * DIM + buckets, return_counts=True)
    return key >> BITS, key & (DIM - 1), n


def _weighted(rows: np.ndarray, buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length: damped counts times weights. Terms without weight are left out."""
    some = idf[buckets] > 0
    r, b, n = _counts(rows[some], buckets[some])
    v = np.sqrt(n) * idf[b]
    if len(r):
        norm = np.sqrt(np.bincount(r, weights=v * v))
        v = v / np.maximum(norm[r], 1e-9)
    return r, b, v.astype(np.float32)


def _sum_rows(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by sorted row numbers."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[cut]] = np.add.reduceat(values, cut, axis=0)
    return out


def embed(rows: np.ndarray, buckets: np.ndarray, n: int, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of n rows in the latent space; zero where a row has no terms."""
    r, b, v = _weighted(rows, buckets, idf)
    x = _sum_rows(r, basis[b] * v[:, None], n)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-6)


def one_version(notes: DataFrame, id_col: str, title: str, summary: str, extra: list[Column]) -> DataFrame:
    """One row for each id: of several rows the one with the longest summary, then the largest values."""
    pick = F.struct(F.length(F.coalesce(summary, F.lit(""))).alias("l"), F.col(title).alias("title"), F.col(summary).alias("summary"), *extra)
    best = notes.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), pick.alias("x")).groupBy("id").agg(F.max("x").alias("x"))
    return best.select("id", "x.*").drop("l")


def seed_columns(notes: DataFrame, labels: DataFrame, subjects: list[str], label_weight: float = 5.0) -> DataFrame:
    """notes (id, title, summary, domain, labels_json) with seed (number of a subject or -1) and weight.

    Notes with one hand label are seeds for it; others are weak seeds if their stored domain is a subject in its right spelling and
    their stored labels name exactly this one.
    """
    ids = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)])
    single = labels.groupBy("guid").agg(F.min("subject").alias("lo"), F.max("subject").alias("hi")).where("lo = hi")
    single = single.select(F.col("guid").alias("id"), ids[F.col("lo")].alias("by_hand"))
    weak = F.when(F.from_json("labels_json", "array<string>") == F.array("domain"), ids[F.col("domain")])
    joined = notes.join(single, "id", "left")
    return joined.select(
        "id", "title", "summary", F.coalesce("by_hand", weak, F.lit(-1)).alias("seed"), F.when(F.col("by_hand").isNotNull(), label_weight).otherwise(1.0).alias("weight")
    )


# ---- features: terms once, as bytes


FEATURES = "id string, seed int, weight double, script int, counts binary, buckets binary"


def features(notes: DataFrame) -> DataFrame:
    """(id, seed, weight, script, counts, buckets): the terms of each note, segment by segment; the first segment is the title.

    counts: number of terms of each segment, 4 bytes each; buckets: the terms, 2 bytes each. script: 0 Han, 1 Latin.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [f"{look_form(t or '')}\n{s or ''}" for t, s in zip(pdf["title"], pdf["summary"])]
            part = (np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE).astype(int) if texts else np.empty(0, int)
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                some = [texts[i] for i in at]
                seg, bucket, of_text = terms_of(some)
                bucket = bucket[np.argsort(seg, kind="stable")].astype(np.uint16)
                counts = np.bincount(seg, minlength=len(of_text)).astype(np.uint32)
                last = np.cumsum(np.bincount(of_text, minlength=len(some)))
                terms = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.concatenate([[0], last])]
                own = [counts[a:b].tobytes() for a, b in zip(np.concatenate([[0], last[:-1]]), last)]
                out = pdf.iloc[at][["id", "seed", "weight"]].copy()
                out["script"] = _script(some)
                out["counts"] = own
                out["buckets"] = [bucket[a:b].tobytes() for a, b in zip(terms[:-1], terms[1:])]
                yield out

    return notes.select("id", "title", "summary", "seed", "weight").mapInPandas(filled_frames(make), FEATURES)


def _script(texts: list[str]) -> np.ndarray:
    """0 for a text of which a third or more is Han, else 1."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    han = np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=_is_han(to_codes("".join(texts)).astype(np.int64)), minlength=len(texts))
    return (han * 3 < lengths).astype(np.int64)


class _Terms:
    """Terms of some notes: row numbers of segments and notes, beside their buckets."""

    def __init__(self, pdf: pd.DataFrame):
        self.n = len(pdf)
        counts = [np.frombuffer(x, np.uint32) for x in pdf["counts"]]
        self.of_text = np.repeat(np.arange(self.n), [len(c) for c in counts])
        counts = np.concatenate(counts) if counts else np.empty(0, np.uint32)
        self.has = counts > 0
        self.seg = np.repeat(np.arange(len(counts)), counts.astype(np.int64))
        self.bucket = np.frombuffer(b"".join(pdf["buckets"]), np.uint16).astype(np.int64)

    @property
    def note(self) -> np.ndarray:
        return self.of_text[self.seg]


def _parts(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def _sum_over(table: DataFrame, columns: list[str], shape: tuple[int, int], add) -> np.ndarray:
    """Sum over all tasks of a matrix that add(terms, pdf, total) adds to: the sums have a fixed size, whatever the input."""
    height = -(-shape[0] // BLOCKS)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((height * BLOCKS, shape[1]), np.float32)
        for pdf in _parts(batches):
            add(_Terms(pdf), pdf, total)
        if total.any():
            yield pd.DataFrame({"block": np.arange(BLOCKS, dtype=np.int32), "sums": [total[i * height : (i + 1) * height].tobytes() for i in range(BLOCKS)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(height * shape[1])
        for x in pdf["sums"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

    schema = "block int, sums binary"
    sums = table.select("counts", "buckets", *columns).mapInPandas(part, schema).groupBy("block").applyInPandas(merge, schema)
    out = np.zeros((height * BLOCKS, shape[1]), np.float32)
    for r in sums.collect():
        out[r["block"] * height : (r["block"] + 1) * height] = np.frombuffer(r["sums"], np.float32).reshape(height, shape[1])
    return out[: shape[0]]


def term_weights(table: DataFrame, subjects: int, least: float = 0.15) -> np.ndarray:
    """Weight of each term bucket: inverse document frequency over all notes times concentration.

    Concentration is how far a term keeps to one subject, 0 (spread evenly) to 1, by the seed notes: the relative entropy of the
    subjects' rates of the term against even rates. Buckets that fewer than 3 seeds hold get 0.3; below least a bucket says nothing and
    gets 0, so that phrases of every note cost nothing in what follows.
    """

    def add(t: _Terms, pdf: pd.DataFrame, total: np.ndarray) -> None:
        r, b, _ = _counts(t.note, t.bucket)
        total[:DIM, 0] += np.bincount(b, minlength=DIM)
        seed, weight = pdf["seed"].to_numpy(np.int64), pdf["weight"].to_numpy(float)
        good = seed[r] >= 0
        cell = b[good] * subjects + seed[r[good]]
        total[:DIM, 1:] += np.bincount(cell, weights=weight[r[good]], minlength=DIM * subjects).reshape(DIM, subjects)
        total[DIM, 0] += t.n
        total[DIM, 1:] += np.bincount(seed[seed >= 0], weights=weight[seed >= 0], minlength=subjects)

    sums = _sum_over(table, ["seed", "weight"], (DIM + 1, subjects + 1), add).astype(float)
    df, n, by, size = sums[:DIM, 0], sums[DIM, 0], sums[:DIM, 1:], sums[DIM, 1:]
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0.0)
    rate = (by + 0.02) / (size + 1)
    rate /= rate.sum(1, keepdims=True)
    spread = (rate * np.log(rate * subjects)).sum(1) / np.log(max(2, subjects))
    spread = np.where(by.sum(1) >= 3, spread, 0.3)
    return (idf * np.where(spread >= least, spread, 0)).astype(np.float32)


def _gram_pass(table: DataFrame, idf: np.ndarray, basis: np.ndarray, centroids: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A^T A basis for the note-term matrix A, and the sums of A basis over the seeds of each (subject, script)."""
    shared = table.sparkSession.sparkContext.broadcast((idf, basis.astype(np.float32)))
    rank = basis.shape[1]

    def add(t: _Terms, pdf: pd.DataFrame, total: np.ndarray) -> None:
        idf, basis = shared.value
        r, b, v = _weighted(t.note, t.bucket, idf)
        x = _sum_rows(r, basis[b] * v[:, None], t.n)
        order = np.argsort(b, kind="stable")
        bs = b[order]
        if len(bs):
            cut = np.flatnonzero(np.concatenate([[True], bs[1:] != bs[:-1]]))
            total[bs[cut]] += np.add.reduceat(x[r[order]] * v[order, None], cut, axis=0)
        if centroids:
            seed = pdf["seed"].to_numpy(np.int64)
            good = seed >= 0
            row = DIM + 2 * seed[good] + pdf["script"].to_numpy(np.int64)[good]
            np.add.at(total, row, (x[good] * pdf["weight"].to_numpy(float)[good, None]).astype(np.float32))

    sums = _sum_over(table, ["seed", "weight", "script"], (DIM + centroids, rank), add)
    return sums[:DIM], sums[DIM:]


class SubjectModel:
    """Fitted embedding, centroids and thresholds. subjects: names in order."""

    def __init__(self, subjects: list[str], idf: np.ndarray, basis: np.ndarray, centroids: np.ndarray):
        self.subjects, self.idf, self.basis = subjects, idf, basis
        #: (subject, script) -> row 2 * subject + script; script 0 Han, 1 Latin
        self.centroids = centroids
        self.least_cosine, self.least_share = 0.25, 0.26

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subject, cosine, lead over the next subject) of each row."""
        cos = x @ self.centroids.T
        by_subject = np.maximum(cos[:, 0::2], cos[:, 1::2])
        best = by_subject.argmax(1)
        at = np.arange(len(x))
        top = by_subject[at, best]
        by_subject[at, best] = -1
        return best, top, top - by_subject.max(1, initial=-1)

    def segments(self, t: _Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(note, subject, cosine, is title) of each segment that has terms."""
        best, top, _ = self.nearest(embed(t.seg, t.bucket, len(t.of_text), self.idf, self.basis))
        title = np.concatenate([[True], t.of_text[1:] != t.of_text[:-1]]) if len(t.of_text) else np.empty(0, bool)
        return t.of_text[t.has], best[t.has], top[t.has], title[t.has]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9).astype(np.float32)


def _refine(table: DataFrame, model: SubjectModel, least: float = 0.4, lead: float = 0.15) -> np.ndarray:
    """Centroids of the segments, over all notes, that are clearly nearest to one subject."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def add(t: _Terms, pdf: pd.DataFrame, total: np.ndarray) -> None:
        m = shared.value
        x = embed(t.seg, t.bucket, len(t.of_text), m.idf, m.basis)
        best, top, gap = m.nearest(x)
        good = (top >= least) & (gap >= lead)
        np.add.at(total, 2 * best[good] + pdf["script"].to_numpy(np.int64)[t.of_text[good]], x[good])

    sums = _sum_over(table, ["script"], model.centroids.shape, add)
    found = np.linalg.norm(sums, axis=1) > 0
    return np.where(found[:, None], _unit(sums), model.centroids)


def decide(text: np.ndarray, subject: np.ndarray, cosine: np.ndarray, title: np.ndarray, n: int, k: int, least_cosine: float, least_share: float) -> np.ndarray:
    """n x k booleans: which subjects each text is about.

    A subject needs least_share of the note's weighed segments and two segments, or the title. At most
    two subjects, the weightier ones.
    """
    good = cosine >= least_cosine
    cell = text[good] * k + subject[good]
    mass = np.bincount(cell, weights=cosine[good], minlength=n * k).reshape(n, k)
    count = np.bincount(cell, minlength=n * k).reshape(n, k)
    named = np.bincount(text[good & title] * k + subject[good & title], minlength=n * k).reshape(n, k) > 0
    total = np.bincount(text, weights=np.maximum(cosine, 0.2), minlength=n)[:, None]
    about = (mass >= least_share * np.maximum(total, 1e-9)) & (mass > 0) & ((count >= 2) | named)
    rank = (-mass).argsort(1, kind="stable").argsort(1)
    return about & (rank < 2)


COSINES = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)
SHARES = (0.1, 0.14, 0.18, 0.22, 0.26, 0.3, 0.34)


def calibrate(model: SubjectModel, labelled: DataFrame) -> dict:
    """Choose the thresholds with the best F1 on all labelled notes (columns counts, buckets, subjects): each pair of thresholds sums up three numbers."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        index = {s: i for i, s in enumerate(m.subjects)}
        total = np.zeros((len(COSINES) * len(SHARES), 3), np.int64)
        for pdf in _parts(batches):
            n, k = len(pdf), len(index)
            truth = np.zeros((n, k), bool)
            for i, names in enumerate(pdf["subjects"]):
                truth[i, [index[s] for s in names if s in index]] = True
            scored = m.segments(_Terms(pdf))
            for at, (least_cosine, least_share) in enumerate((c, s) for c in COSINES for s in SHARES):
                said = decide(*scored, n, k, least_cosine, least_share)
                total[at] += (said & truth).sum(), said.sum(), truth.sum()
        yield pd.DataFrame({"at": np.arange(len(total), dtype=np.int32), "hit": total[:, 0], "said": total[:, 1], "true": total[:, 2]})

    counts = labelled.select("counts", "buckets", "subjects").mapInPandas(count, "at int, hit long, said long, true long")
    rows = counts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("hit", "said", "true")]).collect()  # one row for each pair of thresholds
    if not any(r["true"] for r in rows):
        return {}
    best = max((round(2 * r["hit"] / max(1, r["said"] + r["true"]), 4), COSINES[r["at"] // len(SHARES)], -SHARES[r["at"] % len(SHARES)]) for r in rows)
    model.least_cosine, model.least_share = best[1], -best[2]
    return {"f1": best[0], "least_cosine": best[1], "least_share": -best[2], "labelled": max(r["true"] for r in rows)}


def fit(table: DataFrame, labels: DataFrame, subjects: list[str], rank: int = 48, over: int = 8, still: float = 1e-3, seed: int = 7) -> SubjectModel:
    """table: written features() of one row for each id. labels: guid, subject.

    Two passes of randomised subspace iteration give the right singular vectors of the note-term matrix; the second
    also sums up the seeds. The centroids are refined until none moves by more than still, or they come no closer to rest. All labelled notes serve for the thresholds.
    """
    idf = term_weights(table, len(subjects))
    y, _ = _gram_pass(table, idf, np.random.default_rng(seed).standard_normal((DIM, rank + over)))
    q, _ = np.linalg.qr(y)
    y, seeds = _gram_pass(table, idf, q, 2 * len(subjects))
    _, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    turn = vectors[:, ::-1][:, :rank]
    model = SubjectModel(subjects, idf, (q @ turn).astype(np.float32), _unit(seeds @ turn))
    model.moved = []
    while len(model.moved) < 2 or still < model.moved[-1] < model.moved[-2]:
        refined = _refine(table, model)
        model.moved.append(float(np.linalg.norm(refined - model.centroids, axis=1).max(initial=0)))
        model.centroids = refined
        if model.moved[-1] <= still:
            break
    sets = labels.groupBy("guid").agg(F.collect_set("subject").alias("subjects"))
    model.calibration = calibrate(model, table.join(sets, table["id"] == sets["guid"]))
    return model


def assign(table: DataFrame, model: SubjectModel) -> DataFrame:
    """(id, subject, weight): one row for each note and subject that it is about; weight is the subject's share."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.subjects)
        names = np.array(m.subjects, dtype=object)
        for pdf in _parts(batches):
            text, subject, cosine, title = m.segments(_Terms(pdf))
            about = decide(text, subject, cosine, title, len(pdf), k, m.least_cosine, m.least_share)
            mass = np.bincount(text * k + subject, weights=np.maximum(cosine, 0), minlength=len(pdf) * k).reshape(-1, k)
            i, s = np.nonzero(about)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "subject": names[s], "weight": mass[i, s] / np.maximum(mass[i].sum(1), 1e-9)})

    return table.select("id", "counts", "buckets").mapInPandas(filled_frames(run), "id string, subject string, weight double")


def prepare(notes: DataFrame, labels: DataFrame, subjects: list[str], id_col: str = "guid", domain: str = "primary_domain", labels_json: str = "domain_labels_json") -> DataFrame:
    """The written features of one row for each id: the texts are read once, all later passes read these."""
    extra = [F.col(domain).alias("domain"), F.col(labels_json).alias("labels_json")]
    rows = one_version(notes, id_col, "title", "summary", extra)
    return materialize(features(seed_columns(rows, labels, subjects)), "subject-features")
