import itertools
import random

from pyspark.sql import functions as F

from quillmill.llm import copies, visual


def test_canonical_keeps_signs_that_mean_something():
    c = copies.canonical
    assert c("Hello,  World!") == c("hello world") == c("_HELLO_ “world”……")
    assert len({c("C"), c("C++"), c("C#"), c("C+")}) == 4
    assert c("1.5") != c("15") and c("1,500") == c("1500") and c("3,5") != c("35") and c("1/2") != c("12")
    assert c("-5 x") != c("5 x") and c("- 5 x") == c("5 x") and c("5%") != c("5") and c("$5") != c("5")
    assert c("R&D") != c("RD") and c("a & b") == c("a, b")
    assert c("ﬁn") != c("fin") and c("K") != c("k") and c("Ａ") != c("A") and c("é") != c("é") != c("e")
    assert c("a​b") == c("ab") and c("视⼒") != c("视力")
    assert c("STRASSE") == c("straße") and c(None) == c("") == ""


def test_fields():
    t = copies.canonical_text
    a = "Author: X Y\nTags: a, b\nRemark: It is so."
    assert t(a) == t("- remark ： it is so\n- AUTHOR：x y;\n- Tags: A B") == t("Tags: a b | Author: X Y | Remark: It is so.")
    assert t(a) != t("Author: a, b\nTags: X Y\nRemark: It is so.")
    assert copies.fields_of("I went through 7 records again: the rest; for x: y") is None
    assert copies.fields_of("only: one") is None and copies.fields_of(None) is None
    assert copies.fields_of("标签：；作者：b") == [("标签", ""), ("作者", "b")]


def brute(rows):
    groups = {}
    for i, t, s in rows:
        if i is not None and t and t.strip():
            head = copies.canonical(t) or t
            groups.setdefault((head, copies.canonical_text(s)), set()).add(i)
    return {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_copies_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(f"h{i:04}", rng.choice(["Hot title", "hot  title!", "HOT TITLE"]), None) for i in range(400)]
    rows += [(f"n{i:04}", f"Title {i % 150}", rng.choice(["Some text.", "some text", "other"])) for i in range(700)]
    rows += [("a", None, "x"), ("b", " \t", "x"), (None, "Hot title", None), ("n0001", "Title 1", "Some text."), ("n0001", "Title 1", "Some text."), ("e1", "!!", ""), ("e2", "!!", None)]
    df = spark.createDataFrame(rows, "guid string, title string, summary string").withColumn("canonical_key", F.lit("clash")).withColumn("n", F.lit(1))
    got = [tuple(r) for r in copies.copy_pairs([df, df.limit(0)], hot_share=0.05).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    groups, members, hot = copies.collapse_copies([df], hot_share=0.05)
    assert hot.count() == 1
    assert groups.agg(F.sum("n_ids")).collect()[0][0] == members.count()
    assert groups.agg(F.sum("n_rows")).collect()[0][0] == len([r for r in rows if r[0] and r[1] and r[1].strip()])
    assert copies.copy_pairs([df.limit(0)]).count() == 0


def test_look():
    f = visual.look_form
    same = [
        "Caf\u00e9 No. 5: K\u529b",
        "Cafe\u0301 No. 5\uff1a K\u529b",
        "\uff23\uff41\uff46\u00e9 \uff2e\uff4f\uff0e\u30005: K\u529b",
        "\u0421\u0430f\u00e9 N\u043e. 5: \u039a\u2f12",
        "C\u200baf\u00e9\u2060\u00a0 No. 5: \u212a\u529b ",
    ]
    assert len({f(x) for x in same}) == 1
    for a, b in [("a", "A"), ("e", "é"), ("2", "²"), ("3", "③"), ("1/2", "½"), ("a.b", "a,b"), ("“x”", '"x"')]:
        assert f(a) != f(b)
    assert f("ﬂora") == "flora" and f("Valdéz‐Row") == f("Valdéz-Row") and f("Ⅸ") == "IX" and f("カ") == f("力")
    assert f("") == f("​") == "" and f("STRASSE", True) == f("straße", True)


def test_look_pairs_against_brute_force(spark):
    rng = random.Random(2)
    variants = [lambda x: x, lambda x: x.replace("o", "о"), lambda x: x.replace(" ", " "), lambda x: f"  {x}\t", lambda x: x.upper(), lambda x: x[0] + "​" + x[1:]]
    rows = [(f"g{i:03}", rng.choice(variants)(rng.choice(["a common title", "some other one", "no more"]))) for i in range(150)]
    rows += [("x", None), (None, "no more"), ("y", ""), ("g001", "second title of one"), ("g001", "second title of one")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("look", F.lit("clash"))
    forms = {(i, visual.stored_form(t)) for i, t in rows if i and t and visual.look_form(t)}
    want = {(min(a, b), max(a, b)) for (a, s), (b, u) in itertools.combinations(forms, 2) if a != b and s != u and visual.look_form(s) == visual.look_form(u)}
    for per_salt in (7, 5000):
        got = [tuple(r) for r in visual.look_pairs(df, "id", "text", per_salt).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert visual.look_pairs(df.limit(0), "id", "text").count() == 0
    assert spark.createDataFrame([("ａ",), (None,)], "t string").select(visual.look_column(F.col("t")).alias("x")).collect()[0]["x"] == "a"
