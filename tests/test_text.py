import time
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_scripture_markup(spark):
    lines = [
        r"\id MAT", r"\toc2 x", r"\c 3", r"\c", r"\r ref", r"\ip intro", r"\v 12 abc", r"\p", r"\p text", r"\m text",
        r"a \em x\em* b", r"\em one \em* mid \em two\em* end", r"\bd strong\bd* rest", r"open \em left", "  spaced  ", r"\s1 head",
    ]
    assert column(spark, lines, T.clean_markup("x")) == [
        "", "", "", r"\c", "", "", "abc", "", "text", "text",
        "a  b", "mid  end", "strong rest", r"open \em left", "spaced", "",
    ]


def test_nfc_composes_and_keeps_joiner(spark):
    assert column(spark, ["é", "plain", None, "क्‍ष", "ऩ"], T.nfc("x")) == ["é", "plain", None, "क्‍ष", "ऩ"]


def test_segments(spark):
    text = "एक दुई तीन। चार पाँच॥ छ सात आठ नौ॥ बाँकी शब्द यहाँ"
    assert column(spark, [text, ""], T.segments("x")) == [["एक दुई तीन।", "छ सात आठ नौ॥", "बाँकी शब्द यहाँ"], []]
    assert column(spark, [text], T.split_sentences("x"))[0][1] == "चार पाँच॥"


def test_quote_aware_split(spark):
    cases = {
        "a? b. c": ["a?", "b.", "c"],
        "he said “go? now.” twice. then": ["he said “go? now.” twice.", "then"],
        'x "y. z" w. v': ['x "y. z" w.', "v"],
        "outer “in ‘deep. er’ end.” tail. more": ["outer “in ‘deep. er’ end.” tail.", "more"],
        "it’s plain. next": ["it’s plain.", "next"],
        "never “closed. so one": ["never “closed. so one"],
        "क। “ख। ग?” घ। ङ": None,
    }
    got = column(spark, list(cases), T.split_quoted("x", ".?!।॥"))
    want = list(cases.values())
    want[-1] = ["क।", "“ख। ग?” घ।", "ङ"]
    assert got == want


def test_quote_aware_split_is_linear(spark):
    text = 'word "quoted. part" ' * 20000 + "end. tail"
    assert column(spark, [text], F.size(T.split_quoted("x", ".")))[0] == 2


def test_script_filter(spark):
    rows = ["नमस्ते", "plain ascii", "नमस्तеееееее", "", "   ", "कक‍क中"]
    assert column(spark, rows, T.passes_script("x")) == [True, True, False, False, False, True]
    assert column(spark, ["कककक中"], T.script_ratio("x")) == [0.2]
    assert column(spark, ["कककक中"], T.passes_script("x")) == [True]


def test_transcript_cleaner(spark):
    lines = ["शब्द १ कोरिन्‍थी १:१७, १८; ३:४ अन्त", "वाक्य। ३:४ पछि", "बाँकी १२ टुक्रा१ a b!", "one 5:6"]
    got = column(spark, lines, T.clean_transcript("x"))
    # up to three name words before the reference go with it, but never across a terminator
    assert [(r.text, r.dropped) for r in got] == [("शब्द अन्त", 0), ("वाक्य। पछि", 0), ("बाँकी", 2), ("", 0)]


def test_numerals_and_tokens(spark):
    got = column(spark, ["एक २ तीन३ चार", "no digits"], T.strip_numerals("x"))
    assert [(r.text, r.removed) for r in got] == [("एक चार", 2), ("no digits", 0)]
    assert column(spark, ["a b  c\n"], T.tokens("x")) == [["a", "b", "c"]]
    assert column(spark, ['“क‍ख”, (घ)। a\\b'], T.tokenize_punct("x")) == [["“", "क‍ख", "”", ",", "(", "घ", ")", "।", "a", "\\", "b"]]
    assert column(spark, ["।शब्द—"], T.strip_chars("x", "।॥.,;:!?\"'()[]—-")) == ["शब्द"]


def test_header_lines(spark):
    rows = ["मत्ती.", "एक दुई तीन. ", "एक दुई तीन चार.", "१.", "12.", "मत्ती"]
    assert column(spark, rows, T.book_line("x")) == [True, True, False, True, False, False]
    assert column(spark, rows, T.chapter_line("x")) == [False, False, False, True, True, False]


def test_adapt_text(spark):
    out = column(spark, ["क‍ख। x", "।"], T.adapt_text("x", ["‍", "।", "x"], {"।": ".", "x": "ks"}))
    assert out == ["कख. ks", "."]
    assert column(spark, ["।"], T.adapt_text("x", ["।"])) == [""]


def test_skip_reason(spark):
    df = spark.createDataFrame([("a b c", False), ("", False), ("a b", False), ("a b c", True), (None, True)], "t string, gone boolean")
    reasons = [r.r for r in df.select(T.skip_reason("t", F.col("gone")).alias("r")).collect()]
    assert reasons == [None, "empty transcript", "under 3 words after cleaning", "source file missing", "source file missing"]


def test_adaptation_refuses_emptied_rows(spark):
    from lexiloom.operators import profile as P

    policy = T.adaptation_policy(["\u200d", "।", "x"], danda=".", overrides={"x": "ks"})
    assert policy == {"\u200d": "", "।": ".", "x": "ks"}
    df = spark.createDataFrame([(1, "क\u200dख। x"), (2, "y")], "id int, text string")
    assert [r.text for r in P.adapt_dataset(df, "id", ["\u200d", "।", "x"], policy).orderBy("id").collect()] == ["कख. ks", "y"]
    with pytest.raises(ValueError, match=r"empties 1 rows, such as \[2\]"):
        P.adapt_dataset(df, "id", ["y"])


def test_digit_tokens_of_long_words(spark):
    """A word without a digit costs its length; references go only where there is one."""
    long = "x" * 150_000
    texts = [f"{long} a1b c {long}9 d", "Mark Luke 3:16; 17, rest", "time 3 : 4 k", None, "1a-b2 , 7", "no digits here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    start = time.time()
    got = {r.id: r.c for r in df.select("id", T.clean_transcript("text", T.LATIN_TRANSCRIPT).alias("c")).collect()}
    assert time.time() - start < 30
    assert (got[0].text, got[0].dropped) == (f"{long} c d", 2)
    assert [(got[i].text, got[i].dropped) for i in (1, 2, 4, 5)] == [("rest", 0), ("time k", 2), ("", 3), ("no digits here", 0)]
    assert got[3].text is None
