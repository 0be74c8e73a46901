"""Envelopes: shells in all their forms, prose left alone, brackets in brackets, protected names."""

import random

import pytest

from quernlake.functions import envelope as E

CLEAN = {
    "<msg><text>hello there</text></msg>": "hello there",
    "<msg><text>one</text></msg><msg><text>two</text></msg>": "one\ntwo",
    "<msg><reply>7</reply><text>yes</text><sticker>8</sticker></msg>": "↩7yes[表情8]",
    '<msg id="17">\n<reply>72</reply>\n<text>swan</text>\n<sticker>8</sticker>\n</msg>': "↩72\nswan\n[表情8]",
    '<msg id="1">\n<text>well</text>\n<sticker>8</sticker>\n</msg>': "well\n[表情8]",
    "a <sticker>8</sticker> b\n</sticker> c": "a [表情8] b\nc",
    "<msg><text>he says 3<5 and means <text> so</text></msg>": "he says 3<5 and means <text> so",
    "<msg><text>A</text><text>B</text></msg>": "A<text>B</text>",
    "write <text> like this": "write <text> like this",
    "he wrote <text>this</text> there": "he wrote <text>this</text> there",
    "3 < 5 holds": "3 < 5 holds",
    "fields <msg_id> and <msg_type>": "fields <msg_id> and <msg_type>",
    "alone <msg without an end": "alone <msg without an end",
    "apple<pear>plum": "apple<pear>plum",
    "说到 <msg> 这个词": "说到这个词",
    "<reply>12</reply>he": "↩12he",
    "<at>5</at> come <image> cat </image>": "@5 come [图片cat]",
    "<text><text>x</text></text>": "x",
    "群友发 布鬼图": "群友发布鬼图",
    "很 重 要": "很 重 要",
    "a   b\n\n   \n c \x07d": "a b\nc d",
    "": "",
}
EMPTY = ["<msg/>", "<msg />", "< msg >", "</msg>", "<text/>", "<text></text>", "<Text> </Text>", "<msg/>\n<msg/>", "<quote></quote>", "<msg /><text/>", "<msg></msg><text></text>", "<text/><text />", "<msg a='1'/><text/>", "<forward/>"]


@pytest.mark.parametrize("raw", CLEAN)
def test_clean(raw):
    assert E.clean(raw) == CLEAN[raw]


@pytest.mark.parametrize("raw", EMPTY)
def test_shells_alone_are_nothing(raw):
    assert E.clean(raw) == ""


def test_names_keep_their_blanks():
    assert E.clean("今天星 月来找我") == "今天星月来找我"
    assert E.clean("今天星 月来找我", ("星 月", "月亮")) == "今天星 月来找我"
    assert E.clean("<msg><text>鬼 图，星 月  a来</text></msg>", ("星 月",)) == "鬼图，星 月 a来"


REASONING = {
    "<reasoning>think</reasoning><msg><text>hi</text></msg>": "hi",
    "<reasoning>\nmany\nlines\n</reasoning>\n<msg />": "",
    "<reasoning>open\n<msg><text>body</text></msg>": "body",
    '<REASONING a="1">x</REASONING>body': "body",
    "<reasoning/>body": "body",
    "<reasoning>  </reasoning>": "",
    "<reasoning>open, and no message": "open, and no message",
    "</reasoning>body": "body",
    "<reasoning>a</reasoning>b<reasoning>c</reasoning>d": "bd",
}


@pytest.mark.parametrize("raw", REASONING)
def test_reasoning(raw):
    assert E.clean(E.without_reasoning(raw)) == REASONING[raw]


def test_nested_brackets():
    assert E.trimmed("[Reply ID: -19 content: [hello]]") == "[Reply: hello]"
    out = E.trimmed("[Reply ID: -43 content: [Image a cat in the window]] look")
    assert out.startswith("[Reply: Image a cat") and out.endswith("] look")
    assert E.trimmed(f"[Sticker {'long words ' * 20}]") == f"[Sticker {('long words ' * 20)[:30].rstrip()}…]"
    assert E.trimmed("[Reply ID: 4 content: [2026-09-19 08:09:37] Ann: well]so") == "[Reply: Ann: well]so"
    assert E.trimmed(f"[Image {'d' * 50}, file_path: /a/b.png] x") == f"[Image {'d' * 30}…, file_path: /a/b.png] x"
    assert E.trimmed("[Image never closes [a] and goes on") == "[Image never closes [a] and goes on"
    assert E.trimmed("plain ] text [") == "plain ] text ["
    assert E.without_mention_ids("[At 39(nickname: Ann)] speaks [At -4] ") == "@Ann speaks  "


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for part in ("<text>", "[Image a", "<reasoning>x", "[", "<msg><text>a</text></msg>", "很 重 "):
        raw = part * 20_000
        assert E.trimmed(E.clean(raw)) is not None
    assert time.time() - began < 20


def test_words_outside_tags_survive():
    r = random.Random(1)
    parts = ["<msg>", "</msg>", "<text>", "</text>", "<reply>1</reply>", "<at>", "</at>", "<quote a='b'>", "\n", " ", "<", ">", "[", "]"]
    for _ in range(3000):
        words = [f"w{k}" for k in range(r.randint(0, 6))]
        raw = "".join(x for w in words for x in (*r.choices(parts, k=r.randint(0, 4)), f" {w} "))
        out = E.clean(raw)
        assert all(w in out for w in words) or any(f"<{t}" in raw and ">" in raw for t in ("at", "quote"))


def test_columns(spark):
    rows = [(0, "assistant", "<reasoning>r</reasoning><msg><text>星 月</text></msg>"), (1, "assistant", "<reasoning>r</reasoning><msg>a  b"), (0, "user", "<reasoning>r</reasoning>x"), (None, None, None), (0, "user", "")]
    df = spark.createDataFrame(rows, "level int, role string, text string")
    from pyspark.sql import functions as F

    got = df.select(E.stored_text(F.col("level"), F.col("role"), F.col("text")), E.clean_text(F.col("text"), ("星 月",)), E.model_text(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [("星月", "<reasoning>r</reasoning><text>星 月</text>", "星月"), ("<msg>a  b", "<reasoning>r</reasoning>a b", "a b"), ("<reasoning>r</reasoning>x", "<reasoning>r</reasoning>x", "x"), ("", "", ""), ("", "", "")]
    assert E.spaced_names(spark.createDataFrame([("星 月",), ("a",), (" b ",), (None,)], "name string")) == ("星 月",)
