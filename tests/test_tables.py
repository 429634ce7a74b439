from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import schemas
from hearthline.sources import feeds, tables
from hearthline.sources.commits import Conflict

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def ids(df):
    return sorted(r.id for r in df.collect())


def test_rewrite_from_itself_append_snapshot_clear(spark, tmp_path):
    root = str(tmp_path / "t")
    assert ids(tables.read(spark, root, SCHEMA)) == []
    tables.append(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), root)
    tables.append(spark.createDataFrame([(3, "c")], SCHEMA), root)
    assert ids(tables.read(spark, root, SCHEMA)) == [1, 2, 3]
    tables.snapshot(spark, root, "20240522_090000")
    before = sorted(p.name for p in (tmp_path / "t").glob("v-*"))
    with pytest.raises(Conflict):
        tables.snapshot(spark, root, "20240522_090000")
    assert sorted(p.name for p in (tmp_path / "t").glob("v-*")) == before  # a snapshot writes no rows
    tables.rewrite(tables.read(spark, root, SCHEMA).filter("id <> 2"), root)
    assert ids(tables.read(spark, root, SCHEMA)) == [1, 3]
    tables.clear(spark, root, SCHEMA)
    assert tables.read(spark, root, SCHEMA).schema == SCHEMA and ids(tables.read(spark, root, SCHEMA)) == []
    tables.forget(spark, root)
    assert ids(tables.read_snapshot(spark, root, SCHEMA, "20240522_090000")) == [1, 2, 3]
    assert len(list((tmp_path / "t").glob("v-*"))) == 3  # the two of the snapshot and the empty one


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = lambda *n: spark.createDataFrame([(i, "x") for i in n], SCHEMA)
    tables.append(rows(1), root)
    first = tables._current

    def meanwhile(spark_, root_):
        found = first(spark_, root_)
        monkeypatch.setattr(tables, "_current", first)
        tables.append(rows(2), root_)  # another writer, between our look and our write
        return found

    for write in (tables.rewrite, tables.append):
        monkeypatch.setattr(tables, "_current", meanwhile)
        with pytest.raises(Conflict):
            write(rows(3), root)
    assert ids(tables.read(spark, root, SCHEMA)) == [1, 2, 2]
    assert len(list((tmp_path / "t").glob("v-*"))) == 3


def test_a_reader_never_meets_half_an_append(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.append(spark.createDataFrame([(1, "a")], SCHEMA), root)
    early = tables.read(spark, root, SCHEMA)
    with pytest.raises(Exception, match="no"):
        tables.append(spark.createDataFrame([(2, "b")], SCHEMA).withColumn("v", F.raise_error(F.lit("no")).cast("string")), root)
    tables.append(spark.createDataFrame([(3, "c")], SCHEMA), root)
    assert ids(early) == [1] and ids(tables.read(spark, root, SCHEMA)) == [1, 3]


def test_failed_rewrite_leaves_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.rewrite(spark.createDataFrame([(1, "a")], SCHEMA), root)
    broken = tables.read(spark, root, SCHEMA).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        tables.rewrite(broken, root)
    assert ids(tables.read(spark, root, SCHEMA)) == [1]


def test_schema_contract(spark):
    good = spark.createDataFrame([], schemas.LISTINGS)
    assert tables.check_schema(good, schemas.LISTINGS) is good
    with pytest.raises(tables.SchemaMismatch, match="missing"):
        tables.check_schema(good.drop("address"), schemas.LISTINGS)
    with pytest.raises(tables.SchemaMismatch, match="order"):
        tables.check_schema(good.select(*reversed(good.columns)), schemas.LISTINGS)
    old = spark.createDataFrame([("u", "g")], "url string, extra string")
    new = tables.add_missing_columns(old, schemas.POSTS)
    assert new.columns[:2] == ["url", "extra"] and set(schemas.POSTS.names) < set(new.columns)
    assert new.first().price_val is None


def test_scratch(spark):
    scratch = tables.Scratch(spark, "t")
    df = scratch(spark.range(5), "x")
    assert df.count() == 5 and scratch.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.drop()
    path, fs = tables._hadoop_path(spark, scratch.root)
    assert not fs.exists(path)


def test_text_files(spark, tmp_path):
    (tmp_path / "post_a.txt").write_text("3 חדרים\nקומה 2", encoding="utf-8")
    (tmp_path / "post_b.txt").write_text("סאבלט", encoding="utf-8")
    got = {r.file: r.text for r in feeds.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"post_a.txt": "3 חדרים\nקומה 2", "post_b.txt": "סאבלט"}


def test_text_files_written(spark, tmp_path):
    """A file for each key, whatever its name, in no more folders than asked for."""
    rows = [(str(i), f"post {i}\nחדרים") for i in range(60)] + [("a/b", "x"), ("a%2Fb", "y"), ("twice", "z"), ("twice", "z"), (None, "none"), ("empty", ""), ("null", None)]
    posts = spark.createDataFrame(rows, "k string, t string").repartition(5)
    assert feeds.write_text_files(posts, str(tmp_path), F.col("k"), F.col("t"), folders=4) == 66
    assert sum(f.is_dir() for f in tmp_path.rglob("*")) <= 4 and sum(f.is_file() for f in tmp_path.rglob("*")) == 66
    texts = sorted(r.text for r in feeds.read_text_files(spark, f"{tmp_path}/*/").collect())
    assert texts == sorted([*(f"{t}\n" for k, t in rows[:62]), "z\nz\n", "none\n", "\n", "\n"])
    assert feeds.write_text_files(posts.limit(0), f"file://{tmp_path}/none", F.col("k"), F.col("t")) == 0


def test_page_links(spark):
    pages = [
        '<a role="link" href="/groups/1/posts/2?comment_id=5">x</a><a href="/posts/3">no role</a>'
        '<a role="link" href="/groups/1/posts/2?x=1"><b>3</b> hrs&nbsp;&amp;c</a>',
        "<a role='link' href='https://a.test/marketplace/item/7?ref=1#y'></a><a role='link' href='/posts/1'>z</a>",
        '<a href="/about">x</a>',
        "no markup",
        None,
        '<A class="k"\n ROLE = "link" HREF = "/p/permalink/4">\n yesterday </A>',
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = [(r.url, r.post_date_text) for r in feeds.page_links(df, "https://b.test/").orderBy("i").collect()]
    assert got == [
        ("https://b.test/groups/1/posts/2", "3 hrs\u00a0&c"),
        ("https://a.test/marketplace/item/7", ""),
        (None, None),
        (None, None),
        (None, None),
        ("https://b.test/p/permalink/4", "yesterday"),
    ]
