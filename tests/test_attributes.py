import random
import re

from tests.helpers import PDP_X, PDP_X_ATTRIBUTES, evaluate
from wikisift.functions import presets
from wikisift.functions.attributes import Attribute, Source, extract_attributes

# Segment patterns in their plain forms.
PLAIN_INFOBOX = re.compile(
    r"(?:^|\n)\| *[^\n=]*?=(?:[^|\n{\[]*(?:\{\{(?:.*?\n?)+\}\}|\[\[.*?\]\])? *,?)+"
)
PLAIN_SENTENCE = re.compile(
    r"(?<!\{\{)[A-Z][a-zA-Z]*(?: ?[^\n.{\[ ]+(?:\.\d+)?| \[\[[^\]]*?\]\]| ?\{\{[^}]*?\}\})+"
)


def extract(spark, sources, texts):
    rows = evaluate(spark, lambda c: extract_attributes("value", sources), texts)
    return [None if r is None else [(a.name, a.value) for a in r] for r in rows]


def test_computer_preset(spark):
    assert extract(spark, presets.COMPUTERS, [PDP_X, None, ""]) == [PDP_X_ATTRIBUTES, None, []]


FIRST_SUCCESS = (Source(segment=r"[^;]+", attributes=(
    Attribute("first", r"x=", r"x=(\d)", contains="x="),
    Attribute("all", r"y=", r"(\d)", multiple=True),
    Attribute("either", value=r"(k)v|(q)", multiple=True),
)),)
ALL_RULES = (Source(segment=r"[^;]+", all_attributes=True, attributes=(
    Attribute("both", value=r"(\d)(v)?", multiple=True, concat=True),
    Attribute("parent", value=r"(on)", multiple=True, children=(Attribute("child", value=r"(\d+)"),)),
)),)
NESTED = (Source(segment=r"[^;]+", attributes=(
    Attribute("flag", "OFF", explicit="is off"),
    Attribute("n", value=r"(\d+)"),
    Attribute(None, "on", children=(Attribute("c", value=r"(k)"), Attribute("e", "q", explicit="Q"))),
    Attribute("last", value="(v)"),
)),)
TWO_SOURCES = (Source(attributes=(
    Attribute("one", value=r"x=(\d+)"),
    Attribute("mixed", "k", r"(v)", explicit="K"),
    Attribute("no group", value="k"),
)), Source(segment="k.", attributes=(Attribute("pair", value="(k.)"),)))

# Worked out by hand from what each kind of rule is for.
WORKED = [
    (FIRST_SUCCESS, "x=7;y=12 7", "first=7 all=1 all=2 all=7"),  # each segment ends with its first success
    (FIRST_SUCCESS, "x=7 y=3", "first=7"),
    (FIRST_SUCCESS, "x=k", ""),  # the condition holds, the value does not: the next rules are tried
    (FIRST_SUCCESS, "x=kv", "either=k"),
    (FIRST_SUCCESS, "y=kv q", "either=k either=q"),  # the first group that took part is the value
    (FIRST_SUCCESS, "Y=4;Q", "all=4 either=Q"),  # case does not matter
    (FIRST_SUCCESS, "", ""),
    (ALL_RULES, "1v 2 on", "both=1_v both=2 parent=on child=1"),  # groups joined, children read the segment
    (ALL_RULES, "on on 5;7", "both=5 parent=on child=5 parent=on child=5 both=7"),
    (ALL_RULES, ";;v", ""),
    (NESTED, "off 12", "flag=is_off n=12"),  # a fixed value alone is no success
    (NESTED, "on k q", "c=k e=Q"),  # all children are read, one success is enough
    (NESTED, "on q v", "e=Q last=v"),
    (NESTED, "ON v;on k v", "last=v c=k"),
    (NESTED, "3 on k", "n=3"),
    (TWO_SOURCES, "x=12 k v", "one=12 mixed=K mixed=v pair=k_"),  # without segments nothing stops
    (TWO_SOURCES, "kk", "mixed=K pair=kk"),  # a pattern without groups gives no value
    (TWO_SOURCES, "v x=1", "one=1"),
]


def test_rule_kinds(spark):
    for rules in (FIRST_SUCCESS, ALL_RULES, NESTED, TWO_SOURCES):
        cases = [(text, want) for r, text, want in WORKED if r is rules]
        got = extract(spark, rules, [text for text, _ in cases])
        assert [" ".join(f"{n}={v.replace(' ', '_')}" for n, v in pairs) for pairs in got] == [want for _, want in cases]


def segments(spark, pattern, texts):
    from pyspark.sql import functions as F

    return evaluate(spark, lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), texts)


def test_segment_patterns_match_their_plain_forms(spark):
    rng = random.Random(5)
    infobox = ["|" + "".join(rng.choice("|={}[]a ,\n{}") for _ in range(rng.randint(2, 13))) for _ in range(20000)]
    assert segments(spark, presets.INFOBOX_FIELD, infobox) == [
        [m.group() for m in PLAIN_INFOBOX.finditer(t)] for t in infobox
    ]
    sentence = ["".join(rng.choice("AbB c.1{}[]\n{") for _ in range(rng.randint(2, 14))) for _ in range(20000)]
    assert segments(spark, presets.SENTENCE, sentence) == [
        [m.group() for m in PLAIN_SENTENCE.finditer(t)] for t in sentence
    ]
    # a carriage return ends '.', so a template that holds one is not read over it
    assert segments(spark, presets.INFOBOX_FIELD, ["| a = {{x\r}}"]) == [["| a = "]]


def test_long_texts_do_not_overflow(spark):
    lines = "\n".join(f"* item {i}" for i in range(30_000))
    texts = [
        "\n| manufacturer = {{ubl|\n" + lines + "\n}} [[DEC]]",
        "\n| manufacturer = {{ubl|\n" + lines,
        "Released in 1972 " + "word " * 90_000,
        "A" * 200_000,
    ]
    got = extract(spark, presets.COMPUTERS, texts)
    assert got[0] == [("company", "DEC")]
    assert got[2] == [("release?", "1972")]
    assert got[1] == [] and got[3] == []


def test_unlinked_company_keeps_its_trailing_space(spark):
    got = extract(spark, presets.COMPUTERS, ["\n| owner = Acme Corp [[DEC]]"])
    assert got == [[("company", "Acme Corp "), ("company", "DEC")]]


def test_patterns_with_quotes_and_dollars(spark):
    rules = (Source(attributes=(
        Attribute("it's", value="it's (\\w+)"),
        Attribute('a "b"', value='"(\\w+)"'),
        Attribute("both", value="""'(x)"|(y)'"""),
        Attribute("money", value=r"\$\{(\d)\}|(z)$", explicit="${HOME}"),
    )),)
    text = """it's fine "quoted" y' ${5}"""
    assert extract(spark, rules, [text]) == [[
        ("it's", "fine"), ('a "b"', "quoted"), ("both", "y"), ("money", "${HOME}"), ("money", "5")]]
