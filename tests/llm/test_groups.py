import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import linkage, spans, survivor


# ---- problem 5


def test_times(spark):
    rows = [(1_600_000_000,), (1_600_000_000_000,), (1_600_000_000_000_000,), (0,), (None,), (-5,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t long").select(survivor.instant_micros(F.col("t"))).collect()]
    assert got == [1_600_000_000_000_000] * 3 + [-1] * 3
    seen = spark.createDataFrame([(1_600_000_000_000, "2020-09-13T20:26:39+08:00"), (1_600_000_000_000, "2020-09-13T12:26:40Z"), (1_600_000_000_000, "bad")], "t long, s string")
    assert [r[0] for r in seen.select(survivor.usable_time(F.col("t"), F.col("s"))).collect()] == [-1, 1_600_000_000_000_000, 1_600_000_000_000_000]


def test_survivor_fields_against_brute_force(spark):
    rng = random.Random(3)
    titles = ["T", " t", "Ｔ", "Other", "", None, "  "]
    rows = [(f"g{rng.randrange(60):02}", rng.choice(titles), rng.choice([0, 5, 9, None]), rng.randrange(3), rng.choice([None, "", " ", "a", "b"]), rng.choice([None, "p"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "guid string, title string, u long, c long, summary string, path string").withColumn("k", survivor.title_group(F.col("title"))).withColumn("record", F.lit(1))
    got = {tuple(r) for r in survivor.found_rows(survivor.survivors(df, "k", "guid", ["summary", "path"], ["u", "c"]), "guid", ["summary", "path"]).collect()}
    groups: dict = {}
    for g, t, u, c, s, p in rows:
        key = unicodedata.normalize("NFKC", t or "").casefold().strip()
        if key:
            groups.setdefault(key, []).append(((-1 if u is None else u), c, g, s, p))
    want = set()
    for rs in groups.values():
        if len({r[2] for r in rs}) > 1:
            rs.sort(key=lambda r: r[:3], reverse=True)
            first = min(r[2] for r in rs)
            want.add((first, "guid", rs[0][2]))
            for i, name in ((3, "summary"), (4, "path")):
                have = [r for r in rs if r[i] and r[i].strip()]
                if have:
                    want.add((first, name, have[0][2]))
    # equal freshness of one guid in several rows: only the guid counts
    assert got == want
    assert survivor.survivors(df.limit(0), "k", "guid", ["summary"], ["u"]).count() == 0


def test_layers(spark):
    """The trusted older record comes in the same layer as the newer untrusted one; the policy decides between them."""
    rows = [("k", "a", 9, 0, None, "a2"), ("k", "b", 5, 1, "b1", None), ("k", "c", 1, 0, "c1", "c2")]
    df = spark.createDataFrame(rows, "k string, id string, u long, trust long, f string, g string")
    by = lambda policy: survivor.survivors(df, "k", "id", ["f", "g"], ["u"], ["trust"], policy).collect()[0]
    assert by(["recency", "trust"])["f"]["id"] == "b" and by(["recency", "trust"])["g"]["id"] == "a"
    assert by(["trust", "recency"])["top_id"] in ("a", "b", "c") and by(["trust", "recency"])["f"]["id"] == "b"
    assert [[r["n"] for r in layer] for layer in survivor._layers([{"n": 1, "a": 2, "b": 2}, {"n": 2, "a": 1, "b": 1}, {"n": 3, "a": 3, "b": 0}], ["a", "b"])] == [[1, 3], [2]]


# ---- problem 8


def brute_spans(texts, n):
    where: dict = {}
    for i, t in texts:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    pairs = {(a, b) for w in where.values() for a in w for b in w if a < b}
    cover = {}
    for i, t in texts:
        marks = [False] * len(t or "")
        for k in range(len(t or "") - n + 1):
            if len(where[t[k : k + n]]) > 1:
                marks[k : k + n] = [True] * n
        if any(marks):
            cover[i] = sum(marks)
    return pairs, cover


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh 中文字") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(5, 30))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) - 60)
            parts += [s[cut : cut + rng.randrange(60, 200)], text(5)]
        docs.append((i, "".join(parts)))
    docs += [(100, "=" * 400), (101, "x" + "=" * 300), (102, ""), (103, None), (104, "short"), (105, docs[3][1]), (106, docs[3][1])]
    return docs


def test_shared_spans_against_brute_force(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).repartition(3)
    pairs, cover = brute_spans(docs, 80)
    for limit in (400, 3):  # the second: nearly every anchor by windows
        s = spans.SharedSpans(df, min_span=80, run_limit=limit)
        got = [tuple(r) for r in s.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        assert {r["id"]: r["shared_chars"] for r in s.shared().collect()} == cover
    empty = spans.SharedSpans(df.limit(0), min_span=80)
    assert empty.pairs().count() == 0 and empty.shared().count() == 0


def test_exactly_min_span(spark):
    core = "".join(random.Random(5).choice("qwertz") for _ in range(150))
    docs = [(1, "a" * 90 + core + "b" * 90), (2, "c" * 90 + core + "d" * 90), (3, "e" * 90 + core[:-1] + "f" * 90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spans.SharedSpans(df).pairs().collect()} == {(1, 2)}


# ---- problem 3


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_subsequence():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc中") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        assert linkage.common_subsequence(a, b) == lcs(a, b)
        assert linkage.is_contained(a, b, 0.9) == (lcs(a, b) >= 0.9 * len(a) - 1e-9)


def batches(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(64))

    def edited(t):
        w = t.split(" ")
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice(["“{}”", "{}!", "x {}"]).format(" ".join(w).upper())

    known = [(f"k{i}", hexa(), text(40), f"p/{i}.md", rng.choice(["accepted", "accepted", "rejected"])) for i in range(60)]
    known += [("blank", linkage.EMPTY_BODY, "", None, "accepted"), ("none", None, None, None, "accepted")]
    arrivals = []
    for i in range(160):
        k = rng.choice(known[:60])
        old = rng.choice(arrivals) if arrivals else (0, 0, "k0", hexa(), text(40), None)
        guid, body, summary, path = rng.choice(
            [
                (k[0], k[1].upper(), text(40), k[3]),
                (f"n{i}", f"sha256:{k[1]}", text(40), None),
                (None, hexa(), edited(k[2]), None),
                (k[0], hexa(), text(40), k[3]),
                (f"n{i}", hexa(), text(40), f"q/{i}.md"),
                (f"n{i}", hexa(), edited(old[4] or text(40)), None),
                (f"n{i}", linkage.EMPTY_BODY, "", None),
                (f"n{i}", hexa(), None, None),
            ]
        )
        arrivals.append((i, i // 40, guid, body, summary, path))
    return known, arrivals


def brute_found(known, arrivals):
    hashes = {k[1] for k in known if k[4] == "accepted" and k[1] and k[1] != linkage.EMPTY_BODY}
    texts = {linkage.plain(k[2]) for k in known if k[4] == "accepted"} - {""}
    found = set()
    for i, _, _, body, summary, _ in arrivals:
        h, t = body.lower().removeprefix("sha256:"), linkage.plain(summary)
        if h == linkage.EMPTY_BODY:
            continue
        if h in hashes or (t and any(lcs(t, u) >= 0.9 * len(t) for u in texts)):
            found.add(i)
        hashes.add(h)
        if t:
            texts.add(t)
    return found


def frames(spark, known, arrivals):
    k = spark.createDataFrame(known, "guid string, body_sha256 string, summary string, canonical_path string, outcome string").where("outcome = 'accepted'")
    a = spark.createDataFrame(arrivals, "arrival_id long, batch_no int, guid string, body_sha256 string, summary string, canonical_path string").withColumn("rid", F.lit("clash"))
    return linkage.records(k, F.col("guid"), F.lit(-(1 << 62)), F.lit(0)), linkage.records(a, F.col("arrival_id"), F.col("batch_no"), F.col("arrival_id"))


def test_linkage_at_once_and_batch_by_batch(spark):
    known, arrivals = batches(7)
    want = brute_found(known, arrivals)
    history, incoming = frames(spark, known, arrivals)
    at_once = {int(r[0]) for r in linkage.History(history).probe(incoming).found().collect()}
    assert at_once == want and 20 < len(want) < 150
    h, found = linkage.History(history), set()
    for n in range(2):
        p = h.probe(incoming.where(F.col("ord.b") == n))
        found |= {int(r[0]) for r in p.found().collect()}
        h = h.extended(p)
    assert found == {i for i in want if i < 80}


def test_hot_keys_lose_nothing(spark):
    """A phrase that all texts share is hot on every level; edited copies are found all the same."""
    phrase = "and the same long phrase stands at the start of every single note in this catalog "
    rng = random.Random(8)
    body = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    known = [(f"k{i}", None, phrase + body(), None, "accepted") for i in range(40)]
    arrivals = [(i, 0, None, f"{i:064x}", known[i][2].upper() + "!" if i % 2 else phrase + body(), None) for i in range(20)]
    history, incoming = frames(spark, known, arrivals)
    got = {int(r[0]) for r in linkage.History(history, ("hash",)).probe(incoming).found().collect()}
    assert got == {i for i in range(20) if i % 2} == brute_found(known, arrivals)


def found_ids(spark, known, arrivals):
    history, incoming = frames(spark, known, arrivals)
    return {int(r[0]) for r in linkage.History(history, ("hash",)).probe(incoming).found().collect()}


def test_spread_edits_lose_nothing(spark):
    """One other character in every eleven or fifteen, or others put in after every third: nine tenths still stand in order."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    known = [(f"k{i}", None, text(rng.randrange(60, 300)), None, "accepted") for i in range(30)]
    spread = lambda t, k: "".join("z" if i % k == k - 1 else c for i, c in enumerate(t))
    arrivals = [(i, 0, None, f"{i:064x}", spread(known[i][2], 11 if i % 2 else 15), None) for i in range(20)]
    known += [(f"w{i}", None, "".join(c + "yz" * (j % 3 == 2) for j, c in enumerate(t)), None, "accepted") for i, t in enumerate(text(150) for _ in range(4))]
    arrivals += [(20 + i, 0, None, f"{20 + i:064x}", known[30 + i][2].replace("yz", ""), None) for i in range(4)]
    arrivals += [(24, 0, None, f"{24:064x}", spread(known[0][2], 7), None)]
    assert found_ids(spark, known, arrivals) == set(range(24)) == brute_found(known, arrivals)


def test_edited_copies_over_shared_phrases(spark):
    """All texts are made of the same phrases, so that narrow keys are hot; a letter is changed in every thirty."""
    rng = random.Random(23)
    phrases = ["".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(12)]
    known = [(f"k{i}", None, "".join(rng.sample(phrases, 6)), None, "accepted") for i in range(60)]
    edited = lambda t: "".join("z" if i % 30 == 14 else c for i, c in enumerate(t))
    arrivals = [(i, 0, None, f"{i:064x}", edited(known[i][2]), None) for i in range(12)]
    assert found_ids(spark, known, arrivals) == set(range(12)) == brute_found(known, arrivals)


def test_a_known_block_against_brute_force():
    rng = random.Random(22)
    text = lambda signs, n: "".join(rng.choice(signs) for _ in range(rng.randrange(1, n)))
    for _ in range(100):
        texts = [text("abcdef中文字", 70) for _ in range(rng.randrange(1, 30))]
        new = text("abcdef中文字z", 40)
        texts.append("q".join(new))
        for share in (0.5, 0.9):
            assert sorted(linkage.KnownBlock(texts).holding(new, share).tolist()) == [i for i, t in enumerate(texts) if linkage.is_contained(new, t, share)]


def test_bounds_of_several_words_lose_nothing():
    """Letters of long texts fill several words: what one word passes on counts, and so do texts with too many places."""
    rng = random.Random(24)
    letters = "eeeeeeetttttaaaaooooiiinnnssshhrrddllcumfpgwybvk0123456789"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    cut = lambda t, share: "".join(c for c in t if rng.random() < share)
    texts = [text(rng.randrange(150, 420)) for _ in range(200)] + ["bvkw" * 300, "e" * 900]
    block = linkage.KnownBlock(texts)
    assert len(block.levels[-1][1]) > 1
    for level, (masks, full, beyond) in enumerate(block.levels):
        new = cut(text(250), 0.9)
        mine = [block.code[c] for c in new if block.code.get(c) in masks]
        got = block._missed(level, mine, np.arange(len(texts)))
        read = lambda t: "".join(c for c in t if block.code.get(c) in masks)
        want = [len(mine) - lcs(read(new), read(texts[i])) for i in block.order]
        assert [g for g, b in zip(got, beyond) if not b] == [w for w, b in zip(want, beyond) if not b]
    for _ in range(12):
        new = "".join(c for c in rng.choice(texts) if rng.random() < 0.9) + text(rng.randrange(40))
        for share in (0.8, 0.9):
            assert sorted(block.holding(new, share).tolist()) == [i for i, t in enumerate(texts) if linkage.is_contained(new, t, share)]


def test_few_texts_are_compared_exactly(monkeypatch):
    """Texts of a small alphabet, the known ones half as long again, so that they hold enough of nearly all letters."""
    rng = random.Random(25)
    letters = "eeeeeeeettttttaaaaaooooooiiiinnnnsssshhhhrrrrdddllllccuummffppggwwyybbvk"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    block = linkage.KnownBlock([text(rng.randrange(330, 380)) for _ in range(600)])
    compared = []
    monkeypatch.setattr(linkage.KnownBlock, "_exactly", lambda self, new, live, need: compared.append(len(live)) or live[:0])
    list(block.each_holding([text(220) for _ in range(20)], 0.9))
    assert sum(compared) < 20 * 600 / 100


def test_groups_of_letters_rule_out_before_words_are_joined(monkeypatch):
    """What single groups of letters miss adds up: few texts are left for the dearer comparison of several groups at once."""
    rng = random.Random(26)
    letters = "eeeeeeeettttttaaaaaooooooiiiinnnnsssshhhhrrrrdddllllccuummffppggwwyybbvk"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [text(rng.randrange(330, 380)) for _ in range(600)]
    block = linkage.KnownBlock(texts)
    joined, missed = [], linkage.KnownBlock._missed
    monkeypatch.setattr(linkage.KnownBlock, "_missed", lambda self, level, mine, live: joined.append(len(live)) or missed(self, level, mine, live))
    cut = lambda t: "".join(c for i, c in enumerate(t) if i % 15)
    new = [text(220) for _ in range(20)] + [cut(texts[7]), cut(texts[8]) + "zzzz"]
    found = {i: sorted(at.tolist()) for i, at in block.each_holding(new, 0.9)}
    assert found == {i: at for i, t in enumerate(new) if (at := [k for k, u in enumerate(texts) if linkage.is_contained(t, u, 0.9)])} and 20 in found
    assert sum(joined) < 20 * 600 * 2 / 3


def test_each_cell_of_a_sweep_has_a_task(spark):
    for n in (1, 12, 45):
        parts, key = linkage._cells(spark, n, F.col("id"))
        rows = spark.range(n).withColumn("cell", key).repartition(parts, "cell").select(F.spark_partition_id().alias("p"), "cell").collect()
        assert len({r["p"] for r in rows}) == len({r["cell"] for r in rows}) == n == parts


def test_a_family_of_edited_copies(spark, monkeypatch):
    """Members of a family meet its earliest one, not each other, and none is lost."""
    monkeypatch.setattr(linkage, "FAMILY", 10)
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60))
    edited = lambda i: text[: i * 3] + f" {i:05} " + text[i * 3 :]
    known = [("k0", None, text, None, "accepted")]
    arrivals = [(i, 0, None, f"{i:064x}", edited(i) if i != 7 else "quite another text of which nothing is known yet at all", None) for i in range(60)]
    history, incoming = frames(spark, known, arrivals)
    probe = linkage.History(history, ("hash",)).probe(incoming)
    assert {int(r[0]) for r in probe.found().collect()} == set(range(60)) - {7} == brute_found(known, arrivals)
    assert probe.compared()[0].count() < 60 * 59 / 4


def test_scored_links_all_members_of_a_family(spark, monkeypatch):
    """Known texts that share a long passage but are not the same; the passage alone is the same as each of them."""
    monkeypatch.setattr(linkage, "FAMILY", 10)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = text(200)
    known = [(f"k{i:02}", None, passage + text(150), None, "accepted") for i in range(15)]
    history, incoming = frames(spark, known, [(0, 0, None, f"{0:064x}", passage, None)])
    got = linkage.History(history, ("hash", "guid", "path")).probe(incoming).scored().where("same").collect()
    assert {r["known"] for r in got} == {k[0] for k in known}


def test_empty_history_and_batch(spark):
    known, arrivals = batches(9)
    history, incoming = frames(spark, known, arrivals)
    assert linkage.History(history.limit(0)).probe(incoming.limit(0)).found().count() == 0
    assert linkage.History(history).probe(incoming.limit(0)).found().count() == 0


def test_scores_and_clusters(spark):
    known, arrivals = batches(10)
    history, incoming = frames(spark, known, arrivals)
    scored = linkage.History(history).probe(incoming).scored()
    s = scored.toPandas()
    assert s[s.same].score.mean() > s[~s.same].score.mean()
    assert {int(x) for x in s[s.same].rid} == brute_found(known, arrivals)


def test_union_find(spark):
    mapping = spark.createDataFrame([(f"{i:02}", f"{i:02}") for i in range(20)] + [("z", "00")], "id string, rep string")
    chain = [(f"{i:02}", f"{i + 1:02}") for i in range(0, 12)] + [("15", "16"), ("16", "15"), ("17", "17"), (None, "18"), ("new", "19")]
    got = {r["id"]: r["rep"] for r in linkage.update_representatives(mapping, spark.createDataFrame(chain, "a string, b string")).collect()}
    assert all(got[f"{i:02}"] == "00" for i in range(13)) and got["z"] == "00"
    assert got["13"] == "13" and got["15"] == got["16"] == "15" and got["new"] == got["19"] == "19"
