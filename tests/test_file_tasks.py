"""Small files come many to a task, and texts go back many to a batch."""

import bz2

from surprisal.sources import sinks, text


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.ro").write_text(f"text {i}")
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    files = text._files(spark, f"file://{tmp_path}")
    assert files.count() == 200 and files._jdf.rdd().getNumPartitions() <= 4
    assert spark.conf.get(key) == before
    assert sorted(r.text for r in text.readable_text(spark, f"file://{tmp_path}").collect()) == sorted(f"text {i}" for i in range(200))


def test_members_go_back_in_bounded_batches(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 3000)], "name string, text string")
    folder = f"file://{tmp_path}/tgz"
    sinks.write_texts(rows.coalesce(1), folder, "tgz")
    found = text.any_text(spark, folder)
    assert sorted(len(r.text) for r in found.collect()) == list(range(1, 3000))
    assert sorted(r.at for r in found.collect()) == list(range(2999))


def test_tags_of_odd_words(spark, tmp_path):
    (tmp_path / "a").write_text("\n a/nn  b/c/vb /x d/ e \t/")
    assert text.tagged_words(spark, f"file://{tmp_path}").first().text == "a b/c  d e "


def test_bz2_blocks_are_as_large_as_the_text():
    raw = b"abc " * 100_000
    assert sinks._bz2(raw[:1000])[:4] == b"BZh1" and bz2.decompress(sinks._bz2(raw)) == raw and bz2.decompress(sinks._bz2(b"")) == b""


def test_a_dump_is_read_by_several_tasks(spark, tmp_path):
    page = "<page attr=\"1\">\n<title>T{i}</title><ns>0</ns>\n<id>{i}</id><revision><text xml:space=\"preserve\">'''body''' &lt;b&gt;{i}&lt;/b&gt; é\n{x}</text></revision></page>"
    skipped = "<page><title>no</title><ns>1</ns><revision><text>talk</text></revision></page><page><title>no</title><ns>0</ns><redirect title=\"T\"/><revision><text>r</text></revision></page>"
    dump = "<mediawiki><siteinfo><sitename>x</sitename></siteinfo>\n" + "\n".join(page.format(i=i, x="word " * 1000) + skipped for i in range(100)) + "\n</mediawiki>\n"
    (tmp_path / "dump.xml").write_text(dump)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        found = text.wikipedia(spark, f"file://{tmp_path}/dump.xml")
        assert found._jdf.rdd().getNumPartitions() > 3
        got = {r.title: r.text for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {f"T{i}": f"body {i} é\n" + ("word " * 1000).strip() for i in range(100)}
