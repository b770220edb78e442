import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wikisift.functions import urls as U
from wikisift.functions import values as V
from wikisift.operators import fielded, ranking, skew
from wikisift.operators.fielded import FieldIndex, fielded_search, range_search, show_hits
from wikisift.operators.links import extract_links, frontier
from wikisift.operators.postings import TextIndex, documents_of_term, terms_of_document
from wikisift.operators.ranking import assign_ids, most_frequent_by, ranked, with_positions
from wikisift.operators.search import query_table, search
from wikisift.operators.skew import _grid, full_outer_join
from wikisift.sources.tables import materialize
from tests.helpers import evaluate


@pytest.fixture(scope="module")
def abc(spark):
    docs = spark.createDataFrame([(0, "a a b"), (1, "a c"), (2, "c"), (3, "--")], "doc_id bigint, text string")
    return TextIndex.build(docs)


def hits(df):
    return [(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.orderBy("query_id", "rank").collect()]


def pruned_scans(df):
    """For each scan of a table stored by term: are its partitions pruned at run time?"""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return ["dynamicpruning" in line for line in lines if "FileScan" in line and "term_bucket" in line]


def test_index_tables(abc):
    assert sorted(abc.postings.collect()) == [
        ("a", 0, 2, 2, 5), ("a", 1, 1, 1, 2), ("b", 0, 1, 2, 5), ("c", 1, 1, 1, 2), ("c", 2, 1, 1, 1)]
    assert {r.term: (r.df, round(r.idf, 9)) for r in abc.terms.collect()} == {
        "a": (2, round(math.log(1.5), 9)), "b": (1, round(math.log(3), 9)), "c": (2, round(math.log(1.5), 9))}
    assert sorted((r.doc_id, r.tf_max, round(r.euc, 9), r.len) for r in abc.docs.collect()) == [
        (0, 2, round(1 / math.sqrt(5), 9), 3), (1, 1, round(1 / math.sqrt(2), 9), 2), (2, 1, 1.0, 1)]
    assert sorted(documents_of_term(abc.postings, "a").collect()) == [(0, 2), (1, 1)]
    assert sorted(terms_of_document(abc.vectors, 0).collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("limit", [None, 100])
def test_search_modes(spark, abc, limit):
    l15 = math.log(1.5)
    cases = [
        ("a", {}, [(0, 2 * l15), (1, l15)]),
        ("a b", {}, [(0, 2 * l15 + math.log(3))]),
        ("a", {"tf": "max"}, [(0, l15), (1, l15)]),
        ("a", {"tf": "log"}, [(0, (1 + math.log(2)) * l15), (1, l15)]),
        ("a", {"normalize": "euc"}, [(0, 2 * l15 / math.sqrt(5)), (1, l15 / math.sqrt(2))]),
        ("a b", {"similarity": "cos"}, [(0, 3 / math.sqrt(10))]),
        ("a zzz", {}, []),
        ("- /", {}, []),
        ("b a a B", {}, [(0, 2 * l15 + math.log(3))]),
    ]
    for text, options, expected in cases:
        got = hits(search(query_table(spark, [text]), abc, limit=limit, **options))
        assert got == [(0, d, round(s, 9), i + 1) for i, (d, s) in enumerate(expected)], (text, options)


def test_stored_index_and_mixed_batch(spark, abc, tmp_path):
    stored = abc.save(str(tmp_path / "index"), buckets=7)
    queries = spark.createDataFrame(
        [(0, "a", "log", None, None), (1, "a b", None, None, "cos"), (2, "a", None, "euc", None), (3, "c", None, None, None)],
        "query_id bigint, query_text string, tf string, normalize string, similarity string")
    got = search(queries, stored, limit=10)
    assert hits(got) == hits(search(queries, abc))
    assert [h[:2] for h in hits(got)] == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (3, 1), (3, 2)]
    plan = got._jdf.queryExecution().toString()
    assert pruned_scans(got) == [True]
    assert "WindowGroupLimit" in plan
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_search_without_broadcast_gives_the_same(spark, monkeypatch, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame(
        [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20)))) for i in range(300)],
        "doc_id bigint, text string")
    index = TextIndex.build(docs)
    queries = query_table(spark, ["a b", "c", "a", "d e f g"])
    expected = hits(search(queries, index, limit=7))
    monkeypatch.setattr("wikisift.operators.skew.BROADCAST_ROWS", 2)
    with monkeypatch.context() as patch:
        # a stored index that prunes by the rarest term gives the same
        patch.setattr("wikisift.operators.search.BROADCAST_ROWS", 700)
        stored = index.save(str(tmp_path / "index"), buckets=3)
        some = query_table(spark, ["a b", "c zzz", "d e f g"])
        pruned = search(some, stored, limit=7)
        assert pruned._jdf.queryExecution().executedPlan().toString().count("LeftSemi") == 1
        assert hits(pruned) == hits(search(some, index, limit=7))
    monkeypatch.setattr("wikisift.operators.search.fits_broadcast", lambda df: False)
    assert hits(search(queries, index, limit=7)) == expected
    # limits above what a window prunes take the total order and agree
    monkeypatch.setattr("wikisift.operators.ranking.GROUP_LIMIT", 5)
    assert hits(search(queries, index, limit=7)) == expected


def test_positions_and_ids(spark):
    names = [(f"p{i:04d}",) for i in range(1000)]
    random.Random(2).shuffle(names)
    df = spark.createDataFrame(names, "page_name string").repartition(7)
    got = sorted(assign_ids(df, "page_name", start=5).collect())
    assert got == [(i + 5, f"p{i:04d}") for i in range(1000)]
    assert with_positions(df.limit(0), [F.col("page_name")]).count() == 0


def test_ranked_total_order_matches_window(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, id int, v int")
    order = [F.desc("v"), F.asc("id")]
    full = {(r.g, r.id): r["rank"] for r in ranked(df, "g", order).collect()}
    for g in range(6):
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [full[(g, r[1])] for r in members] == list(range(1, len(members) + 1))
    few = {(r.g, r.id): r["rank"] for r in ranked(df, "g", order, 3).collect()}
    assert few == {k: v for k, v in full.items() if v <= 3}


@pytest.mark.parametrize("limits", [(3, 10**9), (1000, 10**9), (1000, 5), (4, 1)])
def test_full_outer_join_with_frequent_keys(spark, limits):
    rng = random.Random(9)
    keys = ["hot"] * 6 + ["both"] * 4 + ["left hot"] * 5 + [f"k{i}" for i in range(12)] + [None]
    left = [(rng.choice(keys), f"l{i}") for i in range(60)]
    right = [(rng.choice([k for k in keys if k != "left hot"] + ["right hot"] * 8), f"r{i}") for i in range(60)]
    got = full_outer_join(
        spark.createDataFrame(left, "k string, a string"),
        spark.createDataFrame(right, "k string, b string"), "k", *limits)
    expected = [(k, a, b) for k, a in left for k2, b in right if k is not None and k == k2]
    left_keys, right_keys = {k for k, _ in left} - {None}, {k for k, _ in right} - {None}
    expected += [(k, a, None) for k, a in left if k not in right_keys]
    expected += [(k, None, b) for k, b in right if k not in left_keys]
    assert Counter((r.k, r.a, r.b) for r in got.collect()) == Counter(expected)


def test_cells_of_the_grid_are_bounded(spark):
    cases = [(1000, 1000), (1, 50_000), (50_000, 3), (7, 9), (200_000, 200_000), (None, 400)]
    rows = spark.createDataFrame(cases, "l bigint, r bigint").select("l", "r", *(c.alias(n) for n, c in zip("ab", _grid(F.col("l"), F.col("r"), 300, 2000))))
    for r in rows.collect():
        left, right = -(-(r.l or 1) // r.a), -(-(r.r or 1) // r.b)
        assert left <= 300 and right <= 300 and left * right <= 2000 * 1.3  # splits are whole rows


def test_small_cells_do_not_repeat_rows(spark, monkeypatch):
    """400 x 300 pairs in cells of 20: all rows are packed once and moved once."""
    seen = []
    monkeypatch.setattr(skew, "packed", lambda *a, make=skew.packed: seen.append(make(*a)) or seen[-1])
    left, right = (spark.range(n).selectExpr("if(id < 9, concat('k', id), 'hot') AS k", f"id AS {c}") for n, c in ((409, "a"), (309, "b")))
    got = full_outer_join(left, right, "k", 5, 20)
    assert got.count() == 400 * 300 + 9 and got.where("a IS NULL OR b IS NULL").isEmpty()
    assert got.distinct().count() == got.count()
    for packs, side, n in zip(seen, ("left", "right"), (400, 300)):
        sizes = [r[0] for r in packs.selectExpr(f"size(_{side}_rows)").collect()]
        assert sum(sizes) == n and max(sizes) <= 8


def test_most_frequent(spark):
    cases = [[1.0, 2.0, 2.0, 3.0, 3.0, 4.0], [2.5e9], [1.9], [], [float("inf")], [5.0, -1.0]]
    best = evaluate(spark, V.most_frequent, cases, "value array<double>")
    assert best == [2.0, 2.5e9, 1.9, None, float("inf"), -1.0]
    whole = evaluate(spark, lambda c: V.to_int_saturating(V.most_frequent(c)), cases, "value array<double>")
    assert whole == [2, 2147483647, 1, None, 2147483647, -1]
    rows = spark.createDataFrame([(0, v) for v in cases[0]] + [(1, 5.0), (1, -1.0)], "g int, v double")
    assert sorted(most_frequent_by(rows, "g", "v").collect()) == [(0, 2.0), (1, -1.0)]
    odd = [(0, float("nan")), (0, 1.0), (1, None), (1, None), (1, 3.0), (2, None)]
    odd = spark.createDataFrame(odd, "g int, v double")
    assert sorted(most_frequent_by(odd, "g", "v").collect()) == [(0, 1.0), (1, 3.0)]
    least = spark.createDataFrame([(0, -(2**63)), (0, -(2**63)), (0, 5)], "g int, v bigint")
    assert most_frequent_by(least, "g", "v").first().v == -(2**63)
    words = spark.createDataFrame([(0, "b"), (0, "a")], "g int, v string")
    assert most_frequent_by(words, "g", "v").first().v == "a"


def test_numbers(spark):
    assert evaluate(spark, V.parse_number, ["Sixteen", "single", "four", "16", "1.5", "x", None]) == [
        16.0, 1.0, 4.0, 16.0, 1.5, float("inf"), None]
    assert evaluate(spark, V.clock_hertz, ["1.5 MHz", "2 ghz", "3 Hz", "x kHz"]) == [1.5e6, 2e9, 3.0, float("inf")]
    with pytest.raises(Exception, match="Invalid clock speed"):
        evaluate(spark, V.clock_hertz, ["1 THz"])


def test_attribute_strings(spark):
    text = "a:1\t\t b :x:y\t__stackOverflow\t :z\tc: \t:\td:l1\nl2"
    parsed = evaluate(spark, V.attributes_from_string, [text, ""])
    assert [[tuple(a) for a in p] for p in parsed] == [[("a", "1"), (" b ", "x:y"), ("d", "l1\nl2")], []]
    back = evaluate(spark, lambda c: V.attributes_to_string(V.attributes_from_string(c)), [text])
    assert back == ["a:1\t b :x:y\td:l1\nl2"]
    with pytest.raises(Exception, match="Empty name or value"):
        evaluate(spark, lambda c: V.attributes_from_string(c, strict=True), ["a:"])


def test_preference_and_technology(spark):
    bag = "array<struct<name:string,value:string>>"
    value = [("x?", "1"), ("x", "2"), ("y?", "3"), ("x", "2")]
    for name, expected in (("x", ["2", "2"]), ("y", ["3"]), ("z", [])):
        assert evaluate(spark, lambda c: V.preferred_values(c, name), [value], "value " + bag) == [expected]
    flags = [["serial", "vacuum-tubes", "electro-mechanical"], ["electro-mechanical"], []]
    assert evaluate(spark, lambda c: V.technology(c)[0], flags, "value array<string>") == ["serial", "parallel", "parallel"]
    assert evaluate(spark, lambda c: V.technology(c)[1], flags, "value array<string>") == [
        "vacuum-tubes", "electro-mechanical", "transistor"]


PREFIX = "https://site.example/wiki/"


def test_url_rules(spark):
    base = PREFIX + "Main_Page?x=1#y"
    cases = {
        "/wiki/PDP-11#Models": (PREFIX + "PDP-11", True),
        "/wiki/User:X": (PREFIX + "User:X", False),
        "/wiki/File:a.png": (PREFIX + "File:a.png", False),
        "/wiki/Special:WhatLinksHere/X": (PREFIX + "Special:WhatLinksHere/X", False),
        "https://other.example/": ("https://other.example/", False),
        "//cdn.example/a": ("https://cdn.example/a", False),
        "VAX": (PREFIX + "VAX", True),
        "./a/../VAX?q=1": (PREFIX + "VAX?q=1", True),
        "../wiki/x/.": (PREFIX + "x/", True),
        "#top": (PREFIX + "Main_Page?x=1", True),
        "?q=1": (PREFIX + "?q=1", True),
        "mailto:a@b": ("mailto:a@b", False),
        "/../../x": ("https://site.example/../../x", False),
        "../../../x": ("https://site.example/../../x", False),
        "a//../b": (PREFIX + "b", True),
        "/a/./b": ("https://site.example/a/./b", False),
        "a/..": (PREFIX, True),
        "..": ("https://site.example/", False),
        "../..": ("https://site.example/..", False),
        "a/b//c/": (PREFIX + "a/b/c/", True),
    }
    got = evaluate(spark, lambda c: U.resolve_link(F.lit(base), c), list(cases))
    assert got == [url for url, _ in cases.values()]
    assert evaluate(spark, lambda c: U.is_content_url(c, PREFIX), got) == [ok for _, ok in cases.values()]
    assert evaluate(spark, lambda c: U.page_name(c, PREFIX), [PREFIX + "VAX", "http://x/"]) == ["VAX", "http://x/"]


def test_names_and_result_urls(spark):
    assert evaluate(spark, U.decode_file_name, ["Special(3a)Name.html", "a(2f)b(e9)c.html", "x(y).html"]) == [
        "Special:Name", "a/béc", "x(y)"]
    assert evaluate(spark, lambda c: U.result_url(c, "http://w/"), ["A b/C?%é", None]) == ["http://w/A%20b/C%3F%25é", None]


def test_links_and_frontier(spark):
    pages = spark.createDataFrame(
        [(PREFIX + "A", '<a href="/wiki/B">b</a><a href="/wiki/C#x">c</a><a href="/wiki/Talk:B">t</a>'),
         (PREFIX + "B", '<link href="/wiki/C"/><a href="/wiki/A">a</a><a href="http://else/">e</a>')],
        "url string, html string")
    links = extract_links(pages, PREFIX)
    assert sorted(links.collect()) == [("A", "B", 0), ("A", "C", 1), ("B", "A", 1), ("B", "C", 0)]
    known = spark.createDataFrame([("A",), ("B",)], "page_name string")
    assert frontier(links, known).collect() == [("C", "A", 1)]


DOCS = [
    (0, "PDP-X (computer)", None, "PDP-X (computer)", "the pdp-x is serial", ["Digital Equipment"], 1970, 16, 1.5e6, "serial", "vacuum-tubes"),
    (1, "VAX", "VAX", None, "the vax of digital", ["DEC", "Digital"], 1977, 32, None, "parallel", "transistor"),
    (2, "Z3", None, "Z3", "the z3", [], 1941, 22, 5.0, "parallel", "electro-mechanical"),
]
SCHEMA = ("doc_id bigint, title string, site_title string, extern_title string, text string, company array<string>,"
          " release int, word_size int, clock_speed double, architecture string, logic string")


@pytest.fixture(scope="module")
def fields(spark):
    return FieldIndex.build(spark.createDataFrame(DOCS, SCHEMA))


def bm25(query, boosts, only=None):
    """Brute force over DOCS."""
    import re
    names = [c.split()[0] for c in SCHEMA.split(",")]

    def toks(v):
        out = []
        for t in re.findall(r"[a-z0-9](?:[a-z0-9/-]*[a-z0-9])?", v.lower()):
            out += [t] + (re.split("[-/]", t) if re.search("[-/]", t) else [])
        return out

    content = {f: {d[0]: [t for v in (d[names.index(f)] if f == "company" else [d[names.index(f)]]) for t in toks(v)] for d in DOCS} for f in boosts}
    scores = Counter()
    for f, boost in boosts.items():
        docs = {d: t for d, t in content[f].items() if t}
        avg = sum(map(len, docs.values())) / len(docs)
        for term in set(toks(query)):
            df = sum(term in t for t in docs.values())
            for d, t in docs.items():
                if term in t:
                    tf = t.count(term)
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    scores[d] += boost * idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return sorted(((d, round(s, 9)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))


def test_fielded_search(spark, fields, tmp_path):
    boosts = {"title": 4.0, "text": 1.0, "company": 5.0, "architecture": 5.0, "logic": 5.0}
    queries = query_table(spark, ["digital serial", "the", "nothing", "vacuum-tubes pdp-x"])
    for index in (fields, fields.save(str(tmp_path / "fields"))):
        got = fielded_search(queries, index)
        for i, text in enumerate(["digital serial", "the", "nothing", "vacuum-tubes pdp-x"]):
            assert [(h[1], h[2]) for h in hits(got) if h[0] == i] == bm25(text, boosts), text
    # the postings and the terms are read by bucket
    assert pruned_scans(got) and all(pruned_scans(got))
    both = fielded_search(queries, fields, require_all=True)
    assert [h[:2] for h in hits(both) if h[0] == 0] == [(0, 0)]
    ranged = fielded_search(queries, fields, ranges={"release": (1950, 1975), "word_size": (None, 16)})
    assert {h[1] for h in hits(ranged)} == {0}
    own = spark.createDataFrame([(0, "company", "digital")], "query_id bigint, field string, query_text string")
    only = fielded_search(queries.limit(0), fields, field_queries=own)
    assert [(h[1], h[2]) for h in hits(only)] == bm25("digital", {"company": 5.0})
    assert range_search(fields.docs, {"clock_speed": (1.0, None)}).collect() == [(0, 0.0), (2, 0.0)]
    shown = show_hits(only, fields.docs, "https://en.wikipedia.org/wiki/", "https://site.example/wiki/")
    assert sorted((r.title, r.extern_url, r.site_url) for r in shown.collect()) == [
        ("PDP-X (computer)", "https://en.wikipedia.org/wiki/PDP-X%20(computer)", None),
        ("VAX", None, "https://site.example/wiki/VAX")]


@pytest.mark.parametrize("occur", [False, True])
def test_matches_are_dealt_by_document(spark, fields, tmp_path, monkeypatch, occur):
    """With more matches than a task scores, postings are moved once, before they meet the queries."""
    index = fields.save(str(tmp_path / "dealt"), buckets=2)
    queries = spark.createDataFrame([(i, f"serial tubes memory digital vax {i}", "should") for i in range(6)], "query_id int, query_text string, occur string")
    queries = queries if occur else queries.drop("occur")
    expected = fielded_search(queries, index, limit=None).collect()
    monkeypatch.setattr(fielded, "MATCHES_PER_TASK", 1)
    monkeypatch.setattr(ranking, "ROWS_PER_SORT", 1)
    written = []
    monkeypatch.setattr(ranking, "materialize", lambda df, label: written.append((label, df._jdf.queryExecution().executedPlan().toString())) or materialize(df, label))
    got = fielded_search(queries, index, limit=None).collect()
    assert sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in got) == sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in expected)
    scored = dict(written)["unranked"]
    assert re.search(r"Exchange hashpartitioning\(doc_id", scored) and not re.search(r"hashpartitioning\(query_id#\d+, doc_id", scored) and got
