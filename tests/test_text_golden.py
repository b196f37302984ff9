"""Golden cleaning fixture: the original pipeline's own test cases.

Inputs and expected outputs are the published fixture values; empty strings
become nulls before the run, and list order is part of the expectation.
"""

from pyspark.sql import functions as F

from tagweave.functions.text import clean_text_column, process_texts

TITLES = [
    "No data Entered", "Pivotal nurse supPort contract", "This is a completely fine bit o text",
    "fun with spaces.            ", ", fun with PUNCTUATION!", "no title available",
    "CRUKD/0983/3423 grant", "CRUK/83/3423 grant", "wellcome trusT sponsored ",
    "totally normal", "totally normal", "totally normal", "", "",
]
ABSTRACTS = [
    "", "totally normal", "totally normal",
    "    spa.         Ces.                   Dwd.                 ",
    "totally normal", "totally normal", "totally normal", "!totally normal",
    "this work was supported by the francis crick institute which receives its core funding "
    "from the uk medical research council (fc001000), the Wellcome Trust (fc001000),and cancer "
    "research uk (fc001000) totally normal",
    "aim: to learn things", "deSign The future", "reDacted for public dataset",
    "no abstract available for this analysis", "",
]
CLEAN_TITLES = [
    "This is a completely fine bit o text", "fun with spaces.", "fun with PUNCTUATION!", "",
    "grant", "grant", "sponsored", "totally normal", "totally normal", "totally normal", "", "",
]
CLEAN_ABSTRACTS = [
    "", "totally normal", "totally normal", "spa. Ces. Dwd.", "totally normal", "totally normal",
    "totally normal", "totally normal", "totally normal", "to learn things", "The future", "", "",
]
CLEAN_ALLTEXT = [
    "This is a completely fine bit o text totally normal", "fun with spaces. spa. Ces. Dwd.",
    "fun with PUNCTUATION! totally normal", "grant totally normal", "grant totally normal",
    "sponsored totally normal", "totally normal to learn things", "totally normal The future",
]


def _fixture(spark):
    rows = [(i, t or None, a or None) for i, (t, a) in enumerate(zip(TITLES, ABSTRACTS))]
    return spark.createDataFrame(rows, "row_no int, AwardTitle string, AwardAbstract string")


def _ordered(df, col):
    return [r[0] for r in df.orderBy("row_no").select(col).collect()]


def test_clean_titles(spark):
    out = clean_text_column(_fixture(spark), "AwardTitle", "title")
    assert _ordered(out, "AwardTitle") == CLEAN_TITLES


def test_clean_abstracts(spark):
    out = clean_text_column(_fixture(spark), "AwardAbstract", "abstract")
    assert _ordered(out, "AwardAbstract") == CLEAN_ABSTRACTS


def test_process_texts(spark):
    out = process_texts(_fixture(spark), min_char_len=15)
    assert _ordered(out, "AllText") == CLEAN_ALLTEXT


def test_pattern_order_trap(spark):
    # 'aim' fires before 'aims' and leaves 's: x'; leading blanks block a match.
    df = spark.createDataFrame([(0, "Aims: x"), (1, " aim: y"), (2, "Aiming high")],
                               "row_no int, AwardAbstract string")
    out = clean_text_column(df, "AwardAbstract", "abstract")
    assert _ordered(out, "AwardAbstract") == ["s: x", "aim: y", "ing high"]


def test_unicode_whitespace(spark):
    df = spark.createDataFrame([(0, "a   b　"), (1, " ")],
                               "row_no int, AwardTitle string")
    out = clean_text_column(df, "AwardTitle", {"drop": [], "nulls": [], "prefixes": [],
                                               "boiler_plate": []})
    assert _ordered(out, "AwardTitle") == ["a b", ""]


def test_length_counts_code_points(spark):
    df = spark.createDataFrame([(0, "ab\U0001F600", None)], "row_no int, AwardTitle string, AwardAbstract string")
    assert process_texts(df, min_char_len=3).count() == 1
    assert process_texts(df, min_char_len=4).count() == 0
