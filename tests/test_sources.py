import bz2
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tests.helpers import PDP_X, PDP_X_ATTRIBUTES
from wikisift.operators.fielded import FieldIndex, fielded_search
from wikisift.operators.pages import dump_articles, with_attributes
from wikisift.operators.search import query_table, search
from wikisift.operators.searchdocs import build_search_docs, join_titles
from wikisift.plans.dump_pipeline import Topics, build_dump_index
from wikisift.plans.site_index import build_site_index, count_hits, search_pages
from wikisift.sources.dump import DUMP_SCHEMA, list_dumps, read_dump, read_dump_target
from wikisift.sources.site import distinct_pages, read_site
from wikisift.sources.tables import is_complete, materialize, scratch_dir, spread, stream_table, write_once
from wikisift.streaming import incremental as inc


def escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def page_xml(page_id, title, text, ns=0, redirect=None, timestamp="2020-01-02T03:04:05Z"):
    return f"""  <page>
    <title>{escape(title)}</title>
    <ns>{ns}</ns>
    <id>{page_id}</id>
{f'    <redirect title="{redirect}" />' if redirect else ''}
    <revision>
      <id>{page_id + 1000}</id>
      <parentid>7</parentid>
      <timestamp>{timestamp}</timestamp>
      <contributor><username>U</username><id>3</id></contributor>
      <minor />
      <model>wikitext</model>
      <format>text/x-wiki</format>
      <text bytes="{len(text)}" sha1="s" xml:space="preserve">{escape(text)}</text>
      <sha1>abc</sha1>
    </revision>
  </page>
"""


def dump_xml(pages):
    head = '<mediawiki xml:lang="en">\n  <siteinfo><sitename>W</sitename></siteinfo>\n'
    return (head + "".join(pages) + "</mediawiki>\n").encode()


@pytest.fixture(scope="module")
def dump_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    first = [page_xml(1, "PDP-X (computer)", PDP_X), page_xml(2, "PDPX", "#REDIRECT", redirect="PDP-X"),
             page_xml(3, "Talk:PDP-X", PDP_X, ns=1)]
    second = [page_xml(4, "Intel & <co>", "A chip.\n[[Category:Intel processors]]"),
              page_xml(5, "Word", "[[Category:Word processors]] [[Category:computers people]]")]
    (folder / "a.xml.bz2").write_bytes(bz2.compress(dump_xml(first)))
    (folder / "b.xml.bz2").write_bytes(bz2.compress(dump_xml(second)))
    (folder / "notes.txt").write_text("no dump")
    return str(folder)


SITE = {
    "PDP-X": '<p>The <a href="/wiki/PDP-X">PDP-X</a> &amp; more</p> <a href="/c">Category</a>: <a href="/d">Minicomputers</a> PDP-X was sold by <a href="/wiki/DEC">DEC</a> in 1969.',
    "VAX_11": '<p>VAX</p><a href="/c">Categories</a>: <a href="/d">DEC Processors</a><a href="/e">VAXen</a>',
    "VMS": '<a href="/c">Category</a>: <a href="/d">Operating Systems</a>',
    "Plain": "<p>no categories, pdp-x</p>",
    "Category:Computers": '<a href="/c">Category</a>: <a href="/d">Computers</a>',
    "Moved": 'wgInternalRedirectTargetUrl <a href="/c">Category</a>: <a href="/d">Computers</a>',
}


def write_pages(folder, pages):
    for name, html in pages.items():
        file_name = "".join(c if c.isalnum() or c in "_-." else f"({ord(c):x})" for c in name)
        with open(os.path.join(folder, file_name + ".html"), "w") as f:
            f.write(html)


@pytest.fixture(scope="module")
def site_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("site")
    write_pages(folder, SITE)
    (folder / "style.css").write_text("p{}")
    return str(folder)


def test_dump_scan_equals_xml_reader(spark, tmp_path):
    texts = [PDP_X, "tail &amp; </x> <page> \r\n é\tz", "", "{{" * 500, "line\n" * 3000]
    pages = [page_xml(i, f"T{i} & é", texts[i % len(texts)], ns=i % 2, redirect="R" if i % 7 == 0 else None)
             for i in range(800)]
    path = str(tmp_path / "d.xml.bz2")
    with open(path, "wb") as f:
        f.write(bz2.compress(dump_xml(pages), 1))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        ours = read_dump(spark, path)
        theirs = spark.read.schema(DUMP_SCHEMA).option("rowTag", "page").xml(path)
        assert ours.rdd.getNumPartitions() > theirs.rdd.getNumPartitions()
        assert ours.count() == 800
        assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dump_selection_and_articles(spark, dump_folder):
    assert [os.path.basename(r.path) for r in list_dumps(spark, dump_folder, "1").collect()] == ["a.xml.bz2"]
    assert list_dumps(spark, dump_folder).count() == 2
    assert read_dump_target(spark, dump_folder, "1").count() == 3
    assert read_dump_target(spark, dump_folder, "b.xml").count() == 2
    dump = read_dump_target(spark, dump_folder)
    rows = {r.id: r for r in dump.collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].redirect is None and rows[2].redirect._title == "PDP-X"
    assert rows[1].revision.text._VALUE == PDP_X.strip() and rows[1].revision.minor == ""
    assert rows[4].title == "Intel & <co>" and rows[1].revision.timestamp is not None
    found = with_attributes(dump_articles(dump)).collect()
    assert [r.title for r in found] == ["Intel & <co>", "PDP-X (computer)"]
    assert [tuple(a) for a in found[1].attributes] == PDP_X_ATTRIBUTES


def test_dump_filter_is_pushed_to_parquet(spark, dump_folder, tmp_path):
    path = str(tmp_path / "dump.parquet")
    write_once(read_dump_target(spark, dump_folder), path)
    plan = dump_articles(spark.read.schema(DUMP_SCHEMA).parquet(path))._jdf.queryExecution().toString()
    assert "EqualTo(ns,0)" in plan
    assert "ReadSchema: struct<ns:bigint,revision:struct<text:struct<_VALUE:string>>,title:string>" in plan


def test_site_pages(spark, site_folder):
    pages = read_site(spark, site_folder)
    assert {r.page_name: r.html for r in pages.collect()} == SITE
    twice = pages.unionAll(pages)
    assert distinct_pages(twice).count() == len(SITE)


def test_write_once_keeps_finished_and_replaces_broken_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert [r.id for r in write_once(spark.range(3), path).orderBy("id").collect()] == [0, 1, 2]
    assert write_once(spark.range(9), path).count() == 3
    os.remove(os.path.join(path, "_SUCCESS"))
    assert not is_complete(spark, path)
    assert write_once(spark.range(9), path).count() == 9


def test_scratch_tables_follow_the_session_setting(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = materialize(spark.range(5), "x")
    assert table.inputFiles()[0].startswith("file://" + scratch_dir(spark)) and table.count() == 5
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 16


def test_search_document_of_the_example(spark):
    bag = "title string, attributes array<struct<name:string,value:string>>, value string"
    dump = spark.createDataFrame([("PDP-X (computer)", PDP_X_ATTRIBUTES, PDP_X)], bag)
    doc = build_search_docs(join_titles(dump, spark.createDataFrame([], bag))).first()
    assert (doc.title, doc.extern_title, doc.site_title) == ("PDP-X (computer)", "PDP-X (computer)", None)
    assert doc.company == ["Digital Equipment Corporation"]
    assert (doc.release, doc.word_size, doc.clock_speed) == (1970, 16, 1.5e6)
    assert (doc.architecture, doc.logic) == ("serial", "vacuum-tubes")


def test_title_join(spark):
    bag = "title string, attributes array<struct<name:string,value:string>>, value string"
    dump = spark.createDataFrame(
        [("PDP-11 (computer)", [("a", "1")], "d"), ("Only Dump", [], "x"), ("?", [], "q")], bag)
    site = spark.createDataFrame([("PDP-11", [("b", "2")], "s"), ("Only Site", [], "y"), ("!", [], "e")], bag)
    rows = {(r.title, r.extern_title, r.site_title, tuple(map(tuple, r.attributes)), r.value)
            for r in join_titles(dump, site).collect()}
    assert rows == {
        ("PDP-11 (computer)", "PDP-11 (computer)", "PDP-11", (("b", "2"), ("a", "1")), "s d"),
        ("Only Dump", "Only Dump", None, (), "x"),
        ("Only Site", None, "Only Site", (), "y"),
        ("?", "?", "!", (), "e q"),
    }
    apart = join_titles(dump, site, skip_empty_keys=True)
    assert {(r.extern_title, r.site_title) for r in apart.collect()} == {
        ("PDP-11 (computer)", "PDP-11"), ("Only Dump", None), (None, "Only Site"), ("?", None), (None, "!")}


def test_whole_dump_pipeline(spark, dump_folder, site_folder, tmp_path):
    dump_folder = shutil.copytree(dump_folder, tmp_path / "dumps")
    site_folder = shutil.copytree(site_folder, tmp_path / "site")

    def run():
        return build_dump_index(
            spark, str(dump_folder), "*", str(site_folder), str(tmp_path / "work"), str(tmp_path / "index"))

    index = run()
    docs = {r.title: r for r in index.docs.collect()}
    assert set(docs) == {"PDP-X (computer)", "Intel & <co>", "VAX 11"}
    pdp = docs["PDP-X (computer)"]
    assert pdp.site_title == "PDP-X" and pdp.release == 1969 and pdp.company == ["Digital Equipment Corporation"]
    hits = fielded_search(query_table(spark, ["vacuum-tubes", "vax"]), index).collect()
    assert {(h.query_id, h.doc_id) for h in hits} >= {(0, pdp.doc_id), (1, docs["VAX 11"].doc_id)}
    # a second run reads the intermediate tables and replaces the index
    assert sorted(run().docs.collect()) == sorted(docs.values())
    # a dump and a page that arrive later are read too, the others are not read again
    late = dump_xml([page_xml(9, "Late machine", "A machine.\n[[Category:Serial computers]]")])
    (tmp_path / "dumps" / "c.xml.bz2").write_bytes(bz2.compress(late))
    write_pages(tmp_path / "site", {"Late_page": SITE["VAX_11"]})
    assert {r.title for r in run().docs.collect()} - set(docs) == {"Late machine", "Late page"}
    # a dump and a page that change under their names are read again and replace their rows
    changed = dump_xml([page_xml(9, "Changed machine", "A machine.\n[[Category:Serial computers]]")])
    (tmp_path / "dumps" / "c.xml.bz2").write_bytes(bz2.compress(changed) + b"")
    os.utime(tmp_path / "dumps" / "c.xml.bz2", (2e9, 2e9))
    write_pages(tmp_path / "site", {"Late_page": SITE["VAX_11"].replace("VAX", "WAX")})
    os.utime(tmp_path / "site" / "Late_page.html", (2e9, 2e9))
    again = {r.title: r for r in run().docs.collect()}
    assert set(again) - set(docs) == {"Changed machine", "Late page"} and "WAX" in again["Late page"].text
    # what is gone from the folders is gone from the index
    os.remove(tmp_path / "dumps" / "c.xml.bz2")
    os.remove(tmp_path / "site" / "Late_page.html")
    assert {r.title for r in run().docs.collect()} == set(docs)


def test_pipeline_options(spark, dump_folder, site_folder, tmp_path):
    topics = Topics(dump_allow="intel", dump_deny="nothing", site_allow="zzz")
    index = build_dump_index(
        spark, str(dump_folder), "*", str(site_folder), str(tmp_path / "work"), str(tmp_path / "index"), topics, skip_empty_keys=True, saturate=False)
    assert {(r.title, r.site_title) for r in index.docs.collect()} == {("Intel & <co>", None)}


def test_custom_fields_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([(0, "one", ["red", "blue"]), (1, "two", ["green"])], "doc_id bigint, title string, keywords array<string>")
    index = FieldIndex.build(docs, fields=("title", "keywords")).save(str(tmp_path / "f"))
    assert index.searched == ("keywords", "title")
    hits = fielded_search(query_table(spark, ["blue"]), index, boosts={"title": 1.0, "keywords": 2.0})
    assert [r.doc_id for r in hits.collect()] == [0]


def test_streams_of_tables(spark, tmp_path):
    rows = spark.range(50)
    rows.repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("part-*.parquet")).rename(tmp_path / "file.parquet")
    for name in ("folder", "file"):
        stream = stream_table(spark, str(tmp_path / f"{name}.parquet"), "id bigint").writeStream.format("memory")
        stream.queryName(f"stream_{name}").trigger(availableNow=True).start().awaitTermination(60)
        assert spark.table(f"stream_{name}").count() == 50


def test_site_index(spark, site_folder, tmp_path):
    doc_ids, index = build_site_index(read_site(spark, site_folder), str(tmp_path / "site"))
    assert [tuple(r) for r in doc_ids.orderBy("doc_id").collect()] == [
        (0, "PDP-X"), (1, "Plain"), (2, "VAX_11"), (3, "VMS")]
    hits = search_pages(query_table(spark, ["pdp-x", "vax"]), doc_ids, index, "https://s/wiki/", limit=5)
    assert [(r.query_id, r["rank"], r.url) for r in hits.orderBy("query_id", "rank").collect()] == [
        (0, 1, "https://s/wiki/PDP-X"), (0, 2, "https://s/wiki/Plain"), (1, 1, "https://s/wiki/VAX_11")]
    assert sorted(map(tuple, count_hits(hits).collect())) == [(0, 2), (1, 1)]


def test_incremental_index(spark, tmp_path):
    path = str(tmp_path / "inc")
    schema = "page_name string, html string"
    first = spark.createDataFrame([("B", "b x"), ("A", "a x"), ("A", "a x")], schema)
    second = spark.createDataFrame([("C", "c x"), ("A", "changed"), ("Special:Z", "z")], schema)
    inc.create_index(spark, path)
    for batch, pages in enumerate([first, second]):
        inc.incremental_index(pages, path, batch, "r")
    expected = [(0, "A", 0), (1, "B", 0), (2, "C", 1)]

    def ids():
        return sorted(tuple(r) for r in inc.read_table(spark, path, "doc_ids").select("doc_id", "page_name", "batch_id").collect())

    assert ids() == expected
    # a batch that runs again replaces itself
    inc.incremental_index(second, path, 1, "r")
    assert ids() == expected
    # another run with the same batch number replaces nothing
    third = spark.createDataFrame([("D", "d"), ("A", "again")], schema)
    for _ in range(2):
        inc.incremental_index(third, path, 1, "other")
        assert ids() == [*expected, (3, "D", 1)]
    # vectors of a batch whose ids were not written do not count
    inc.read_table(spark, path, "vectors").limit(1).drop("run", "batch_id").write.parquet(f"{path}/vectors/run=lost/batch_id=7")
    assert inc.read_table(spark, path, "vectors").count() == 4
    inc.incremental_index(third.where("page_name = 'A'"), path, 1, "other")
    assert ids() == expected
    index = inc.stored_index(spark, path)
    assert {r.term: r.df for r in index.terms.collect()} == {"a": 1, "b": 1, "c": 1, "x": 3}
    assert [r.doc_id for r in search(query_table(spark, ["c x"]), index).collect()] == [2]


def test_stream_of_page_files(spark, tmp_path):
    folder, path = tmp_path / "pages", str(tmp_path / "idx")
    folder.mkdir()
    for pages in ({"A": "<b>alpha</b>", "B": "beta"}, {"C(x)": "alpha gamma"}):
        write_pages(folder, pages)
        query = inc.stream_index(inc.stream_site(spark, str(folder)), path, str(tmp_path / "ckpt"))
        assert query.awaitTermination(120)
    ids = {r.page_name: r.doc_id for r in inc.read_table(spark, path, "doc_ids").collect()}
    assert ids == {"A": 0, "B": 1, "C(x)": 2}
    hits = search(query_table(spark, ["alpha"]), inc.stored_index(spark, path))
    assert {r.doc_id for r in hits.collect()} == {0, 2}


def test_rows_of_one_row_group_are_spread_before_filters(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(20_000).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = spark.read.parquet(path)
        # As many splits as cores, but all rows in one of them.
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        even = spread(table)
        tasks = even.where("id % 3 > 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) <= 5000
    assert even.agg(F.count("id"), F.sum("id")).first() == (20_000, 199_990_000)
    assert spread(spark.range(100).limit(0)).count() == 0
