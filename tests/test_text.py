import random
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import evaluate
from wikisift.functions import text as T

# The tag pattern and the known entities.
PLAIN_TAG = re.compile(
    r'<[\/!]?([\w-]+)\s*(?:\s*[\w-](?:=(?:"[^"]*")|[^\s"]+)?\s*)*\/?>', re.ASCII
)
ENTITIES = {"&amp;": "&", "&gt;": ">", "&lt;": "<", "&quot;": '"'}


OPEN, CLOSE, ESC = map(chr, (0xFDD0, 0xFDD1, 0xFDD2))


def plain_text(html):
    """Expected text: the pieces between tags, told from the whole list of tags which of them show."""
    tags = [(m.start(), m.end(), m[1], m[0].startswith("</")) for m in PLAIN_TAG.finditer(html)]
    scripts = [(start, not closes) for start, _, name, closes in tags if name == "script"]
    begins = [0] + [end for _, end, _, _ in tags]
    ends = [start for start, _, _, _ in tags] + [len(html)]
    marks = [{True: "]]", False: "[["}[closes] if name == "a" else "" for *_, name, closes in tags] + [""]

    def hidden(at):
        return next((opens for start, opens in reversed(scripts) if start < at), False)

    shown = [html[b:e] if e == len(html) and b == begins[-1] or not hidden(b) else "" for b, e in zip(begins, ends)]
    text = "".join(piece for pair in zip(shown, marks) for piece in pair)
    return "".join(ENTITIES.get(part, part) for part in re.split("(&(?:amp|gt|lt|quot);)", text))


def test_html_to_text_fixtures(spark):
    cases = {  # fixed values
        "&amp;": "&",
        "&amp;lt;": "&lt;",
        "&nbsp;": "&nbsp;",
        '<b>3BSD</b> was <a href="/wiki/x" title="Unix/32V">Unix/32V</a> ok': "3BSD was [[Unix/32V]] ok",
        '<script>var a="x";</script>hi<script async="" src="/w"></script>bye': "hibye",
        '<!-- c --><a href="x">L</a>': "L]]",
        "<input disabled>text</p>more": "more",
        '<script>x<a href="y">z</a>w</script>k': "[[]]k",
        "<script/>x<p>tail": "tail",
        "a</script>b<!script>c</script>d": "abd",
        "<script>x<script>y</script>z": "z",
        "": "",
    }
    got = evaluate(spark, T.html_to_text, list(cases))
    # an unclosed script at the end still gives its rest: the tail is always kept
    assert got == [plain_text(c) for c in cases]
    for case, result in zip(cases, got):
        assert result == cases[case], case


def test_html_to_text_random_pages(spark):
    rng = random.Random(7)
    parts = ["<a", "<a href=\"x\">", "</a>", "<script>", "</script>", "<p>", "<b c", ">", '"', "=", " ",
             "/", "x", "&lt;", "&amp;", "<!-- y -->", "<!script>", "<br/>", "\n", "<ab:c>", OPEN, CLOSE,
             ESC, OPEN + "a" + CLOSE, "<script src=\"k\"/>", "é"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(20000)]
    got = evaluate(spark, T.html_to_text, pages)
    wrong = [(p, g, plain_text(p)) for p, g in zip(pages, got) if g != plain_text(p)]
    assert not wrong, wrong[:5]


def test_unknown_entity_raises_on_request(spark):
    with pytest.raises(Exception, match="Unknown entity &nbsp;"):
        evaluate(spark, lambda c: T.html_to_text(c, unknown="error"), ["a&nbsp;b"])
    assert evaluate(spark, lambda c: T.html_to_text(c, unknown="error"), ["a&amp;b"]) == ["a&b"]


def test_hostile_pages_finish(spark):
    pages = [
        "<b " + "a" * 50_000 + '"',
        "<y " + "word " * 60_000,
        "<p>" * 60_000 + "end",
        "<script>" + "<a>x</a>" * 30_000 + "</script>z",
        '<i x="' + "q" * 100_000,
    ]
    got = evaluate(spark, T.html_to_text, pages)
    assert got[0] == pages[0] and got[1] == pages[1] and got[2] == "end"
    assert got[3] == "[[]]" * 30_000 + "z" and got[4] == pages[4]


def test_tokens(spark):
    cases = {
        "The BA11-P card cage from DEC was used in PDP-11/60 to hold the CPU, main memory and device controllers.":
            "the,ba11-p,ba11,p,card,cage,from,dec,was,used,in,pdp-11/60,pdp,11,60,to,hold,the,cpu,main,memory,and,device,controllers",
        "com/pub/pdp11/empty/rl02": "com/pub/pdp11/empty/rl02,com,pub,pdp11,empty,rl02",
        "a--b x": "a--b,a,,b,x",
        "- /": "",
    }
    got = evaluate(spark, T.tokens, list(cases))
    assert [",".join(t) for t in got] == list(cases.values())


def test_term_vector(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d-e".split()) for _ in range(n)) for n in range(0, 40)]
    got = evaluate(spark, lambda c: T.term_vector(T.tokens(c)), texts)
    for text, vector in zip(texts, got):
        words = [w for t in text.split() for w in ([t] + t.split("-") if "-" in t else [t])]
        assert [(v.term, v.tf) for v in vector] == [(w, words.count(w)) for w in sorted(set(words))]
    assert evaluate(spark, lambda c: T.term_vector(T.tokens(c)), [None]) == [[]]


def test_titles(spark):
    assert evaluate(spark, T.normalize_title, ["PDP-X (computer)", "(a) (b)", "Ω"]) == ["pdp-x pdp x", "", ""]
    assert evaluate(spark, T.title_from_page_name, ["PDP-11_x"]) == ["PDP-11 x"]


def test_categories(spark):
    assert evaluate(
        spark, T.dump_categories, ["[[Category:Vacuum tube computers|x]] [[Category:Serial computers]]", "none"]
    ) == ["vacuum tube computers|serial computers", ""]
    assert evaluate(
        spark, T.site_categories,
        ["x [[Categories]]: [[A b]][[C]] [[D]]", "[[Category]]: [[Unibus]]", "[[Category]]: none"],
    ) == ["A b|C", "Unibus", None]


def test_token_bag_and_vectors_as_tokens_in_order(spark):
    from collections import Counter

    from wikisift.operators.postings import document_vectors

    texts = ["PDP-11/60 and pdp-11", "-a- b//c d--e/", "plain words, plain", "x-y x/y x-y a", "--", "", None, "é-1 naïve/7-"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = df.select("doc_id", T.tokens(F.col("text")).alias("t"), T.token_bag(F.col("text")).alias("bag")).collect()
    vectors = {r.doc_id: r for r in document_vectors(df).collect()}
    for row in rows:
        assert (row.bag is None) == (row.t is None) and sorted(row.bag or []) == sorted(row.t or [])
        counts, vector = Counter(row.t or []), vectors[row.doc_id]
        assert {t.term: t.tf for t in vector.terms} == counts and [t.term for t in vector.terms] == sorted(counts)
        assert (vector.len, vector.tf_max, vector.sum_sq) == (sum(counts.values()), max(counts.values(), default=0), sum(n * n for n in counts.values()))
