"""Long exact spans shared between documents (problem 8), by relative Lempel-Ziv factors.

The reference is the whole corpus, cut into blocks: one block of text around each anchor. Anchors are the minimizers
of the text: the gram with the smallest hash of every window, so that any two texts with an equal stretch of min_span
characters have an anchor in common at the same place of that stretch. The anchors are the index of the
reference. Every document is factored against every block that the index has for its anchors: the
factor is the longest equal stretch around the anchor. A block reaches as far as min_span - gram characters to either side, so a
factor of min_span characters or more is decided within one block; a factor that runs to a boundary of its block goes
on in the block of the next anchor, and the pieces are merged. No equal stretch of min_span
characters is missed, and hashes only propose: characters decide (for anchors with more than run_limit places, two
independent 64-bit hashes of whole windows do).

Texts shorter than min_span, empty and null texts share nothing. A text that repeats within itself only is not shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import filled_frames, materialize

GRAM = 50
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD1342543DE82EF95)
_powers: dict = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(key, -1, 1 << 64))
        made = []
        for b in (base, inverse):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[key] = tuple(made)
    up, down = _powers[key]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def rolling_hash(codes: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of each stretch of width codes."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _power_tables(base, n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x632BE5AB)) * up[:n], out=prefix[1:])
    return _mix((prefix[width:] - prefix[:-width]) * down[: n + 1 - width])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of width values."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[:-rest], out[rest:]) if rest else out


def to_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def anchors_of(texts: list[str], min_span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of the anchors of a few texts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = to_codes("".join(texts))
    width = min_span - gram + 1
    none = np.empty(0, np.int64)
    if len(codes) < min_span:
        return none, none, np.empty(0, np.uint64)
    h = rolling_hash(codes, gram)
    least = _sliding(h, width, np.minimum)  # least[s]: of the window of min_span characters from s
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(least))
    inside = at + min_span <= ends[owner[: len(least)]]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    chosen = np.flatnonzero(best == h)
    who = owner[chosen]
    return who, chosen - starts[who], h[chosen]


def _chunks(ids: np.ndarray, texts: list[str], least: int) -> Iterator[tuple[list, list[str]]]:
    """Texts of at least that length, some CHUNK characters at a time."""
    some, own, size = [], [], 0
    for i, t in zip(ids, texts):
        if t is None or len(t) < least:
            continue
        some.append(t)
        own.append(i)
        size += len(t)
        if size >= CHUNK:
            yield own, some
            some, own, size = [], [], 0
    if some:
        yield own, some


def anchor_table(docs: DataFrame, min_span: int) -> DataFrame:
    """docs (id, text) -> (h, id, pos): the index of the reference."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, some in _chunks(pdf["id"].to_numpy(), pdf["text"].tolist(), min_span):
                who, pos, h = anchors_of(some, min_span)
                yield pd.DataFrame({"h": h.view(np.int64), "id": np.asarray(own, dtype=np.int64)[who], "pos": pos.astype(np.int32)})

    return docs.mapInPandas(filled_frames(find), "h long, id long, pos int")


def _blocks(min_span: int):
    """Cut the blocks of the reference around the anchors of each text."""
    reach = min_span - GRAM

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["h", "id", "pos", "off", "block"]).astype({"h": "int64", "id": "int64", "pos": "int32", "off": "int32"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for i, text, own in zip(pdf["id"], pdf["text"], pdf["anchors"]):
                for a in own:
                    p = a["pos"]
                    start = max(0, p - reach)
                    rows.append((a["h"], i, p, p - start, text[start : p + GRAM + reach]))
                if len(rows) >= 10_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return filled_frames(cut)


_BLOCK_SCHEMA = "h long, id long, pos int, off int, block string"


def _matrix(blocks: list[str], offs: np.ndarray, reach: int) -> np.ndarray:
    """Blocks as rows of codes, aligned at their anchors; each missing place differs from all others."""
    width = 2 * reach + GRAM
    flat = to_codes("".join(blocks))
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    rows = np.repeat(np.arange(len(blocks)), lengths)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(reach - offs, lengths)
    out = np.repeat((np.arange(len(blocks), dtype=np.uint32) + np.uint32(0x200000))[:, None], width, axis=1)
    out[rows, cols] = flat
    return out


def factors(m: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how far the rows a and b of m agree to the left and to the right of the start of the anchor."""
    differ = m[a] != m[b]
    width = differ.shape[1]
    rightward = differ[:, reach:]
    right = np.where(rightward.any(1), rightward.argmax(1), width - reach)
    leftward = differ[:, :reach][:, ::-1]
    left = np.where(leftward.any(1), leftward.argmax(1), reach)
    return left, right


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return cut, np.diff(np.concatenate([cut, [len(h)]]))


def _pairs_in_runs(sizes: np.ndarray, starts: np.ndarray, at_once: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each run, some thousands at a time."""
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        these = starts[sizes == size]
        step = max(1, at_once // len(i))
        for k in range(0, len(these), step):
            s = these[k : k + step, None]
            a, b = (s + i).ravel(), (s + j).ravel()
            for x in range(0, len(a), at_once):
                yield a[x : x + at_once], b[x : x + at_once]


def _factor_runs(min_span: int, intervals: bool):
    """Factor the blocks of each anchor against each other; input sorted by h."""
    reach = min_span - GRAM

    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        h, ids, pos = pdf["h"].to_numpy(), pdf["id"].to_numpy(), pdf["pos"].to_numpy()
        m = _matrix(pdf["block"].tolist(), pdf["off"].to_numpy(), reach)
        starts, sizes = _runs(h)
        found = []
        for a, b in _pairs_in_runs(sizes, starts):
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            left, right = factors(m, a, b, reach)
            long = left + right >= min_span
            a, b, left, right = a[long], b[long], left[long], right[long]
            if intervals:
                for x in (a, b):
                    found.append(pd.DataFrame({"id": ids[x], "first": pos[x] - left, "last": pos[x] + right}))
            else:
                found.append(pd.DataFrame({"doc_a": np.minimum(ids[a], ids[b]), "doc_b": np.maximum(ids[a], ids[b])}))
        return pd.concat(found).drop_duplicates() if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None and len(held):
                pdf = pd.concat([held, pdf], ignore_index=True)
            h = pdf["h"].to_numpy()
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            held = pdf.iloc[last:]
            if last and (out := work(pdf.iloc[:last].reset_index(drop=True))) is not None:
                yield out
        if held is not None and len(held) and (out := work(held.reset_index(drop=True))) is not None:
            yield out

    return filled_frames(run)


def _windows(min_span: int):
    """All windows of min_span characters of each block, by two hashes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for i, p, off, block in zip(pdf["id"], pdf["pos"], pdf["off"], pdf["block"]):
                codes = to_codes(block)
                w1 = rolling_hash(codes, min_span)
                if len(w1):
                    w2 = rolling_hash(codes, min_span, _BASE2)
                    parts.append(pd.DataFrame({"w1": w1.view(np.int64), "w2": w2.view(np.int64), "id": i, "start": (p - off + np.arange(len(w1))).astype(np.int32)}))
            if parts:
                yield pd.concat(parts)

    return filled_frames(cut)


class SharedSpans:
    """Spans of min_span or more characters that documents have in common.

    docs needs id_col (bigint, unique) and text_col. Anchors with more than run_limit places are not compared
    pairwise but by the hashes of all their windows, whose number is linear in the text.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = 150, run_limit: int = 400):
        if min_span <= GRAM:
            raise ValueError(f"min_span must be over {GRAM}")
        self.min_span = min_span
        slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_span))
        anchors = materialize(anchor_table(slim, min_span), "anchors")
        repeated = (
            anchors.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where(F.col("lo") != F.col("hi")).select("h", "n")
        )
        places = anchors.join(repeated, "h").groupBy("id").agg(F.collect_list(F.struct("h", "pos", "n")).alias("anchors"))
        self.limit = run_limit
        with_text = slim.join(places, "id")
        small = F.filter("anchors", lambda a: a["n"] <= run_limit)
        large = F.filter("anchors", lambda a: a["n"] > run_limit)
        self.hot = bool(repeated.where(F.col("n") > run_limit).limit(1).count())
        self._small = with_text.select("id", "text", small.alias("anchors")).where(F.size("anchors") > 0)
        self._large = with_text.select("id", "text", large.alias("anchors")).where(F.size("anchors") > 0)

    def _run(self, intervals: bool, schema: str) -> DataFrame:
        blocks = self._small.mapInPandas(_blocks(self.min_span), _BLOCK_SCHEMA)
        return blocks.repartition("h").sortWithinPartitions("h").mapInPandas(_factor_runs(self.min_span, intervals), schema)

    def _hot_windows(self) -> DataFrame:
        blocks = self._large.mapInPandas(_blocks(self.min_span), _BLOCK_SCHEMA)
        windows = blocks.mapInPandas(_windows(self.min_span), "w1 long, w2 long, id long, start int")
        return materialize(windows.distinct(), "windows")

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b, for each two documents that share a span."""
        found = self._run(False, "doc_a long, doc_b long")
        if self.hot:
            windows = self._hot_windows().select("w1", "w2", "id").distinct()
            same = windows.groupBy("w1", "w2").agg(
                F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2")
            )
            # neighbouring windows of one passage are held by the same documents; one of them is enough
            one = same.where(F.col("n") > 1).groupBy("n", "s1", "s2").agg(F.min(F.struct("w1", "w2")).alias("w")).select("w.w1", "w.w2", F.ceil(F.col("n") / 2000).cast("int").alias("salts"))
            held = windows.join(one, ["w1", "w2"])
            left = held.select("w1", "w2", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("doc_a"))
            right = held.select("w1", "w2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("doc_b"))
            found = found.unionByName(left.join(right, ["w1", "w2", "salt"]).where("doc_a < doc_b").select("doc_a", "doc_b"))
        return found.distinct()

    def shared(self) -> DataFrame:
        """(id, n_spans, shared_chars, longest) of each document of which something stands elsewhere too.

        Overlapping spans count once. n_spans counts merged stretches.
        """
        found = self._run(True, "id long, first int, last int")
        if self.hot:
            windows = self._hot_windows()
            twice = windows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("w1", "w2")
            found = found.unionByName(windows.join(twice, ["w1", "w2"]).select("id", F.col("start").alias("first"), (F.col("start") + self.min_span).alias("last")))
        lists = found.groupBy("id", "first").agg(F.max("last").alias("last")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("x"))
        merged = F.aggregate(
            "x",
            F.expr("named_struct('n', 0, 'chars', 0, 'longest', 0, 'a', -1, 'b', -1)"),
            lambda s, x: F.when(
                x["first"] <= s["b"],
                F.struct(s["n"].alias("n"), s["chars"].alias("chars"), s["longest"].alias("longest"), s["a"].alias("a"), F.greatest(s["b"], x["last"]).alias("b")),
            ).otherwise(
                F.struct(
                    (s["n"] + 1).alias("n"),
                    (s["chars"] + s["b"] - s["a"]).alias("chars"),
                    F.greatest(s["longest"], s["b"] - s["a"]).alias("longest"),
                    x["first"].alias("a"),
                    x["last"].alias("b"),
                )
            ),
        )
        return lists.select("id", merged.alias("m")).select(
            "id",
            F.col("m.n").alias("n_spans"),
            (F.col("m.chars") + F.col("m.b") - F.col("m.a")).alias("shared_chars"),
            F.greatest(F.col("m.longest"), F.col("m.b") - F.col("m.a")).alias("longest"),
        )
