from pyspark.sql import functions as F

from quillmill.functions import markdown as M
from quillmill.functions import text as T


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"t {kind}")
    return df.select(make(F.col("t")).alias("x")).collect()[0]["x"]


def test_visible_text(spark):
    html = "<div>A&amp;B<script>var x = '<b>';</script> <!-- c --> <p>C &lt; D</p></div><style>p {}</style>"
    assert one(spark, html, T.visible_text) == "A&B C < D"
    assert M.parsed_text(html) == "A&B C < D"
    assert one(spark, None, T.visible_text) == "" and one(spark, "", T.visible_text) == ""


def test_counts_have_their_own_bounds(spark):
    narrow = lambda term: lambda c: T.count_narrow(T.fold(c), term)
    wide = lambda term: lambda c: T.count_wide(T.fold(c), term)
    text = "AI agents aid: ai, OpenAI AI助手 GPT4 gpt 基金会与基金 c++ C++ hugging faces"
    assert one(spark, text, narrow("AI")) == 3
    assert one(spark, text, narrow("c++")) == 2
    assert one(spark, text, narrow("hugging face")) == 1  # a substring by the narrow rule
    assert one(spark, text, wide("hugging face")) == 0
    assert one(spark, text, wide("gpt")) == 2
    assert one(spark, text, narrow("gpt")) == 1
    assert one(spark, text, wide("基金")) == 1
    assert one(spark, text, narrow("基金")) == 2
    assert one(spark, None, narrow("ai")) is None


def test_terms_by_presence(spark):
    has = lambda term: lambda c: T.has_term(T.full_fold(c), term)
    assert not one(spark, "training solution", has("AI")) and not one(spark, "training solution", has("SOL"))
    assert one(spark, "ＡＩ助手与SOL交易", has("AI")) and one(spark, "AI助手与SOL交易", has("sol"))
    assert not one(spark, "x", has(""))


def test_header(spark):
    text = '---\ntitle: "a \\"b\\" c"\nsource_guid: \'g1\'\ndomain: AI\ndomain: Quant\nbad line\n---\n\n# Head \n\ntext'
    f = one(spark, text, T.header_fields)
    assert f == {"title": 'a "b" c', "source_guid": "g1", "domain": "Quant"}
    assert one(spark, text, lambda c: T.first_heading(T.body_of(c))) == "Head"
    assert one(spark, "---\nopen: 1\n# x", T.header_fields) == {}
    assert one(spark, "no header", T.body_of) == "no header"


def test_names_and_summaries(spark):
    assert one(spark, "a/b:c?.md ", T.safe_filename) == "a_b_c_.md"
    assert one(spark, "con.txt", T.safe_filename) == "_con.txt"
    assert one(spark, "...", T.safe_filename) == "untitled"
    long = one(spark, "x" * 200 + ".md", T.safe_filename)
    assert len(long) == 120 and long.endswith(".md")
    assert one(spark, "短。", T.cache_summary) == "短。"
    assert one(spark, "字" * 359 + "，；尾", T.cache_summary) == "字" * 359 + "……"


def test_note_summaries(spark):
    """Expected sentences as the operator's definition gives them, case by case."""
    summary = lambda text: one(spark, text, lambda c: T.note_summary(c, F.lit("题"))).replace("\n", "|")
    assert summary("# H\n\n这是一句足够长的正文内容，请看。然后还有。\n\n## 1. 第一节\n\n### 2.1、 第二节 ##\n## 附件\n") == "这是一句足够长的正文内容，请看。本文目录包括“第一节”、“第二节”等内容。"
    assert summary("![x](a.png)") == summary("==========") == summary("") == "该笔记主要以图片形式呈现“题”相关内容。"
    assert summary("这一段没有句号但是足够长了：") == "这一段没有句号但是足够长了。"
    assert summary("字" * 200) == "字" * 180 + "。"
    assert summary("字" * 179 + "，尾巴很长") == "字" * 179 + "。"
    frame = ["来源：某某出版社的长长的名字", "共 1200 字，阅读需 4 分钟左右吧", "2024-01-01 12:00:00", "同一个短语而已 同一个短语而已。", "学员上岸啦，欢迎大家都来看看吧", "关注公众号获取更多的资料和内容", "> 引用的一行引用的一行引用的一行", "    缩进的代码缩进的代码缩进的代码", "短句"]
    for line in frame:
        assert summary(line + "\n正文在这里，它有足够的长度。") == "正文在这里，它有足够的长度。", line
    assert one(spark, "# a\n\n> q\n  " + "x" * 130, T.first_effective_line) == "x" * 120 and one(spark, "# a", T.first_effective_line) == "暂无摘要"


def test_plain_notes(spark):
    note = '<?xml version="1.0"?><!DOCTYPE en-note><en-note a="b"><h2>T</h2><p>a <b>b</b>&nbsp;<a href="u">l</a></p><ul><li>x</li></ul>1<br/>2</en-note>'
    assert one(spark, note, T.plain_note) == "## T\na b\xa0[l](u)\n\n<ul>- x\n</ul>1\n2"
    assert one(spark, None, T.plain_note) == ""


def test_code_blocks():
    html = '<div style="--en-codeblock:true"><div>a = 1</div><div>b = <i>2</i></div></div><div>after</div>'
    assert M.to_markdown(html) == "```\na = 1\nb = 2\n```\n\nafter"
    assert M.parsed_text("<p>a&lt;b</p><SCRIPT>x</script ><style>y<!-- z -->") == "a<b"


def test_markup_kinds(spark):
    got = spark.createDataFrame([("<HTML><Head></head><body><pre><p>",), ("<en-note><div>",), (None,)], "x string").select(*T.markup_summary(F.col("x"))).collect()
    assert [r["kind"] for r in got] == ["html", "enml", "fragment"] and got[0]["p_count"] == 2 and got[1]["div_count"] == 1 and not got[2]["has_body"]


def test_markdown():
    html = '<h1>T</h1><p>a <b>b</b> <a href="u">l</a></p><ul><li>x</li><li>y</li></ul><en-todo checked="true"/>done<en-media type="image/png" hash="' + "0" * 32 + '"/><pre>c  d</pre><svg><p>no</p></svg>'
    out = M.to_markdown(html, {"0" * 32: "f.png"})
    assert "# T" in out and "**b**" in out and "[l](u)" in out and "- x\n- y" in out
    assert "- [x] done" in out and "![f.png](_attachments/f.png)" in out and "```\nc  d\n```" in out and "no" not in out
    assert M.normalise("# T\n\n# Other\n\n\n\n1\nFirst\n```\n# code\n```", "t") == "## Other\n\n1. First\n```\n# code\n```"
    assert M.to_markdown(None) == "" and M.normalise(None, None) == ""
